"""How tests are told from other code, by language: plain functions for the extractors."""

from __future__ import annotations

import re

# ---- fixed values
IGNORED = (".git", "node_modules", "vendor", "__pycache__", ".venv", ".vscode", ".idea", ".DS_Store", "dist", "build", ".cache", "tmp", ".goru", ".db")
MOST_BYTES = 10 * 1024 * 1024
EXTENSIONS = (".py", ".go", ".ts", ".tsx", ".js", ".jsx")

GO_ASSERTIONS = (
    "t.Error", "t.Errorf", "t.Fatal", "t.Fatalf", "t.Fail", "t.FailNow", "t.Log", "t.Logf", "t.Skip", "t.Skipf", "t.SkipNow", "assert.", "require.",
    "Equal", "NotEqual", "True", "False", "Nil", "NotNil", "Zero", "NotZero", "Contains", "NotContains", "Greater", "Less", "Empty", "NotEmpty", "Len", "InDelta",
)
GO_UTILITIES = ("t.", "b.", "m.", "testing.", "assert.", "require.", "Mock", "mock", "Stub", "stub", "Spy", "spy", "setup", "teardown", "Setup", "Teardown")
GO_LIBRARY = ("fmt.", "log.", "os.")

PY_DECORATORS = ("@pytest.mark", "@unittest", "@parameterized", "@mock.patch", "@patch", "@skip", "@skipIf", "@expectedFailure", "@test", "@Test", "@given", "@hypothesis", "@property_test")
PY_FRAMEWORKS = (
    ("pytest", ("import pytest", "from pytest", "@pytest")),
    ("unittest", ("import unittest", "from unittest", "TestCase")),
    ("nose", ("import nose", "from nose")),
    ("hypothesis", ("import hypothesis", "@given")),
)
PY_TYPES = (
    ("integration", ("integration", "e2e", "end_to_end", "endtoend")),
    ("performance", ("performance", "benchmark", "speed", "timing")),
    ("smoke", ("smoke",)),
    ("property", ("property", "hypothesis")),
)
PY_ASSERTIONS = ("self.assert", "pytest.raises", "pytest.warns", "pytest.approx", "pytest.fail", "pytest.skip", "pytest.xfail", "nose.assert", "sure.assert", "expect(", "should.", "assertThat", "hamcrest.", "mock.assert")
PY_UTILITIES = ("self.assert", "pytest.", "unittest.", "mock.", "Mock", "patch", "fixture", "setUp", "tearDown", "setUpClass", "tearDownClass", "skip", "xfail", "raises", "warns", "approx")
PY_BUILTINS = ("print", "len", "str", "int")
PY_FLAGS = {
    "parameterized": ("@parameterized", "@pytest.mark.parametrize"),
    "can_skip": ("pytest.skip", "unittest.skip", "@skip"),
    "uses_mocks": ("mock", "Mock", "@patch", "MagicMock"),
    "uses_fixtures": ("@fixture", "fixture"),
    "external_dependencies": ("database", "db", "requests", "http"),
}
GO_FLAGS = {
    "parallel": ("t.Parallel()",),
    "has_cleanup": ("t.Cleanup(",),
    "has_subtests": ("t.Run(",),
    "table_driven": ("tests := []", "testCases := []"),
    "uses_mocks": ("mock", "Mock", "gomock", "testify"),
}
TS_PATHS = (".test.ts", ".test.tsx", ".test.js", ".test.jsx", ".spec.ts", ".spec.tsx", ".spec.js", ".spec.jsx", "__tests__/", "__test__/", "tests/", "test/")
TS_CONTENT = (
    "describe(", "describe.only(", "describe.skip(", "it(", "it.only(", "it.skip(", "test(", "test.only(", "test.skip(", "suite(", "suite.only(", "suite.skip(",
    "@jest/globals", "from 'jest'", 'from "jest"', "from 'mocha'", 'from "mocha"', "from 'vitest'", 'from "vitest"', "from 'jasmine'", 'from "jasmine"', "@testing-library",
)
TS_FRAMEWORKS = (
    ("jest", ("from '@jest/globals'", "from 'jest'", "jest.fn()", "jest.mock(", "jest.spyOn(", "expect.assertions(", "expect.hasAssertions(", "toMatchSnapshot()", "toMatchInlineSnapshot(")),
    ("vitest", ("from 'vitest'", 'from "vitest"', "vi.fn()", "vi.mock(", "vi.spyOn(", "import.meta.vitest")),
    ("mocha", ("from 'mocha'", 'from "mocha"', "suite(", "suite.only(", "suite.skip(", "setup(", "teardown(", "suiteSetup(", "suiteTeardown(")),
    ("jasmine", ("from 'jasmine'", 'from "jasmine"', "jasmine.createSpy(", "jasmine.createSpyObj(", "spyOn(", "spyOnProperty(")),
    ("testing-library-react", ("@testing-library/react",)),
    ("testing-library", ("@testing-library",)),
    ("jest", ("describe(", "it(", "test(")),
)
TS_TYPES = (
    ("unit", ("unit", "should return", "should calculate", "should transform")),
    ("integration", ("integration", "api", "endpoint", "database", "service")),
    ("component", ("component", "render", "display", "ui")),
    ("e2e", ("e2e", "end to end", "flow", "scenario")),
    ("snapshot", ("snapshot", "match")),
)
# ---- end of fixed values

TEST_CONFIDENCE = 0.8


def has(text: str, parts) -> bool:
    return any(p in text for p in parts)


def first(text: str, rules, default: str) -> str:
    return next((name for name, parts in rules if has(text, parts)), default)


def flags(text: str, rules: dict) -> dict[str, str]:
    return {k: "true" for k, parts in rules.items() if has(text, parts)}


def go_is_test(path: str, name: str, signature: str) -> bool:
    if not path.endswith("_test.go"):
        return False
    return bool(re.match(r"(Test|Benchmark)[A-Z]", name)) or name.startswith("Example") or bool(re.search(r"\*testing\.[TBM]\b", signature))


def go_test_type(name: str, signature: str) -> str:
    if name.startswith("Benchmark") and name != "Benchmark":
        return "benchmark"
    if name.startswith("Example") and name != "Example":
        return "example"
    if has(name.lower(), ("integration", "e2e", "endtoend")):
        return "integration"
    return "suite" if "*testing.M" in signature else "unit"


def go_production_call(call: str) -> bool:
    return bool(call) and not has(call, GO_UTILITIES) and not call.startswith(GO_LIBRARY)


def py_is_test_file(path: str) -> bool:
    base = path.rsplit("/", 1)[-1]
    return base.startswith("test_") and base.endswith(".py") or base.endswith("_test.py") or base == "tests.py" or "test" in path.lower()


def py_is_test(path: str, name: str, parent_class: str | None, decorators: list[str]) -> bool:
    if not py_is_test_file(path):
        return False
    if name.startswith("test_") and name != "test_" or re.match(r"test[A-Z]", name):
        return True
    if parent_class and has(parent_class, ("Test", "test")) and name.startswith("test"):
        return True
    return any(d.startswith(PY_DECORATORS) for d in decorators)


def py_framework(content: str, name: str) -> str:
    return first(content, PY_FRAMEWORKS, "pytest" if name.startswith("test_") else "unittest")


def py_target(name: str) -> str:
    if name.startswith("test_"):
        return name[5:]
    return name[4].lower() + name[5:] if re.match(r"test[A-Z]", name) else ""


def py_is_assertion(call: str) -> bool:
    return has(call + "(", PY_ASSERTIONS)


def py_production_call(call: str) -> bool:
    return bool(call) and not has(call, PY_UTILITIES) and call not in PY_BUILTINS


def ts_is_test_file(path: str, content: str) -> bool:
    return has(path, TS_PATHS) or has(content, TS_CONTENT)
