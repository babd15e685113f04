"""TypeScript and JavaScript files, JSX among them, by a scanner."""

from __future__ import annotations

import re

from ..functions import test_rules as T
from .collect import Rows, Spans, closing, mask

_ID = r"[A-Za-z_$][\w$]*"
_FUNCTION = re.compile(rf"(?P<export>export\s+)?(?:default\s+)?(?P<async>async\s+)?function\s*\*?\s*(?P<name>{_ID})\s*(?P<generic><[^>(]*>)?\s*\(")
_ARROW = re.compile(rf"(?P<export>export\s+)?(?:const|let|var)\s+(?P<name>{_ID})\s*(?::[^=\n]+)?=\s*(?P<async>async\s*)?(?:<[^>(]*>\s*)?(?P<open>\()")
_CLASS = re.compile(rf"(?P<export>export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+(?P<name>{_ID})\s*(?P<generic><[^{{]*?>)?\s*(?P<heritage>[^{{]*)\{{")
_METHOD = re.compile(rf"^[ \t]*(?:(?:public|private|protected|static|readonly|override|abstract|get|set)\s+)*(?P<async>async\s+)?\*?(?P<name>{_ID}|#\w+)\s*(?:<[^>(]*>)?\s*\(", re.M)
_INTERFACE = re.compile(rf"(?P<export>export\s+)?(?:declare\s+)?interface\s+(?P<name>{_ID})\s*(?P<generic><[^{{]*?>)?\s*(?:extends\s+(?P<extends>[^{{]+))?\{{")
_TYPE = re.compile(rf"(?P<export>export\s+)?(?:declare\s+)?type\s+(?P<name>{_ID})\s*(?P<generic><[^=]*>)?\s*=\s*")
_ENUM = re.compile(rf"(?P<export>export\s+)?(?:declare\s+)?(?:const\s+)?enum\s+(?P<name>{_ID})\s*\{{")
_SPACE = re.compile(rf"(?P<export>export\s+)?(?P<declare>declare\s+)?(?P<kind>namespace|module)\s+(?P<name>{_ID}(?:\.{_ID})*|['\"][^'\"]*['\"])\s*\{{")
_IMPORT = re.compile(r"^[ \t]*import\s+(?P<type>type\s+)?(?:(?P<what>[^'\";]*?)\s+from\s+)?(?P<q>['\"])(?P<path>[^'\"\n]*)(?P=q)", re.M)
_EXPORT_FROM = re.compile(r"^[ \t]*export\s+(?:type\s+)?(?P<what>\*(?:\s+as\s+\w+)?|\{[^}]*\})\s+from\s+(?P<q>['\"])(?P<path>[^'\"\n]*)(?P=q)", re.M)
_EXPORT = re.compile(rf"^[ \t]*export\s+(?:default\s+(?P<default>{_ID})\s*;?\s*$|\{{(?P<names>[^}}]*)\}}(?!\s*from))", re.M)
_DYNAMIC = re.compile(r"\bimport\(\s*['\"]([^'\"]+)['\"]")
_VARIABLE = re.compile(rf"(?P<export>export\s+)?\b(?P<kind>const|let|var)\s+(?P<name>{_ID})\s*(?::\s*(?P<type>[^=;\n]+?))?\s*(?:=(?!>)\s*(?P<value>[^\n;]*))?[;\n]")
_CALL = re.compile(rf"(?<![\w$.])((?:this\.|super\.)?{_ID}(?:\??\.{_ID})*)\s*(?:<[\w, .\[\]]*>)?\(")
_DECORATOR = re.compile(rf"@({_ID}(?:\.{_ID})*)(\()?")
_JSX = re.compile(rf"(?<![\w$)\].])<([A-Z][\w$.]*)((?:\s+[\w-]+(?:=(?:\"[^\"]*\"|'[^']*'|\{{[^}}]*\}}))?)*)\s*/?>")
_KEYWORDS = {"if", "for", "while", "switch", "catch", "function", "return", "typeof", "await", "new", "constructor", "super", "import", "require", "do", "else", "throw", "in", "of", "void", "delete"}
_SUITES = {"describe", "context", "suite", "fdescribe", "xdescribe"}
_CASES = {"it", "test", "specify", "fit", "xit", "xtest"}
_HOOKS = {"beforeEach", "afterEach", "beforeAll", "afterAll", "before", "after", "setup", "teardown", "suiteSetup", "suiteTeardown"}
_MOCKS = (("function", ("jest.fn", "vi.fn")), ("module", ("jest.mock", "vi.mock")), ("stub", ("sinon.stub",)), ("spy", ("spyOn", "sinon.spy")))
_RENDERS = (("render", "testing-library"), ("mount", "enzyme"), ("shallow", "enzyme"))
_API = ("fetch", "axios", "http.", "$http", "$.ajax", "$.get", "$.post")
#: In a service's method, what tells that it calls an API.
_API_WORDS = ("http", "fetch", "axios")
_ROUTE = re.compile(r"(?:app|router)\.(get|post|put|delete|patch|all)$")
_BRANCH = re.compile(r"\b(if|for|while|case|catch)\b|&&|\|\||\?\?")


def _string(content: str, at: int) -> str:
    m = re.compile(r"\s*(['\"`])((?:\\.|(?!\1).)*)\1", re.S).match(content, at)
    return m[2] if m else ""


def _outermost(masked: str, keep: str = "") -> str:
    """Arguments without what is in brackets; keep: opening brackets that stay as marks."""
    out, depth = [], 0
    for c in masked:
        if c in "([{":
            out.append(c if depth == 0 and c in keep else " ")
            depth += 1
        elif c in ")]}":
            depth -= 1
        elif depth == 0:
            out.append(c)
    return "".join(out)


class _Scanner:
    def __init__(self, path: str, content: str):
        lang = "javascript" if re.search(r"\.jsx?$", path) else "typescript"
        self.path, self.content, self.masked = path, content, mask(content)
        self.test_file = T.ts_is_test_file(path, content)
        self.framework = T.first(content, T.TS_FRAMEWORKS, "unknown") if self.test_file else ""
        self.out = Rows(path, content, lang, self.test_file)
        self.spans = Spans()
        self.classes = Spans()
        self.handlers: list[tuple] = []
        self.defined: set[int] = set()  # where methods are named, which is no call
        self.names: dict[str, str] = {}
        self.decorated = [(m.start(), m[1], closing(self.masked, m.end() - 1) + 1 if m[2] else m.end()) for m in _DECORATOR.finditer(self.masked)]

    def body_after(self, at: int) -> tuple[int, int]:
        """Brace and end of the body after a parameter list's parenthesis at at; (-1, end of line) if there is none."""
        i = closing(self.masked, at) + 1
        while i < len(self.masked):
            c = self.masked[i]
            if c == "{":
                before = self.masked[:i].rstrip()
                end = closing(self.masked, i)
                if before.endswith((":", "|", "&", "<")):  # an object type, not a body
                    i = end + 1
                    continue
                return i, end + 1
            if c in ";\n" and not self.masked[i:].lstrip().startswith(("{", "=>", ":")):
                return -1, i
            if c in "([":
                i = closing(self.masked, i)
            i += 1
        return -1, len(self.masked)

    def decorators(self, at: int) -> list[str]:
        """Decorators that end right before a declaration."""
        out = []
        for a, name, end in reversed(self.decorated):
            if end <= at and not re.sub(r"\b(export|default|abstract|public|private|protected|static|async|readonly)\b", "", self.masked[end:at]).strip():
                out.append(f"@{name}")
                at = a
        return out[::-1]

    def add(self, label, name, start, end, parent=None, calls=True, **more):
        decorators = self.decorators(start)
        ident = self.out.node(label, name, start, end, parent_id=parent, decorators=decorators, **more)
        if calls:
            self.spans.add(start, end, ident)
        self.names.setdefault(name, ident)
        for d in decorators:
            self.out.node("Decorator", d[1:], start, start, parent_id=ident)
            self.out.edge("DECORATES", ident, d[1:], start, props={"decorator_name": d})
        return ident

    def generics(self, ident, text, at):
        for g in re.finditer(rf"({_ID})(?:\s+extends\s+([^,=>]+))?", (text or "").strip("<>")):
            self.out.node("Generic", g[1], at, at, parent_id=ident, type_definition=(g[2] or "").strip())
            if g[2]:
                self.out.edge("CONSTRAINS", ident, g[2].strip().split("<")[0], at, props={"constraint_type": g[2].strip()})

    def code(self, name, m, open_at, label, parent=None, **props):
        opened, end = self.body_after(open_at)
        code, body = self.masked[max(opened, 0) : end], self.content[m.start() : end]
        params = self.content[open_at : closing(self.masked, open_at) + 1]
        rest = self.content[open_at + len(params) : opened] if opened > 0 else ""
        returns = re.match(r"\s*:\s*(.+?)\s*(?:=>)?\s*$", rest, re.S)
        jsx = bool(_JSX.search(code)) or bool(re.search(r"return\s*\(?\s*<\w", code))
        start = m.start() + len(m.group()) - len(m.group().lstrip())
        ident = self.add(label, name, start, end, parent, signature=params, body=body, is_exported=bool(m.groupdict().get("export")), complexity=1 + len(_BRANCH.findall(code)), props={"default": bool(re.match(r"\s*export\s+default\b", m.group())), "return_type": returns and returns[1], "async": bool(m.groupdict().get("async")), "jsx": jsx, **props})
        if re.match(r"use[A-Z]", name):
            self.out.node("Hook", name, start, end, parent_id=ident)
        elif jsx and name[:1].isupper():
            self.out.node("Component", name, start, end, parent_id=ident, props={"framework": "react"})
        for p in re.finditer(rf"[(,]\s*(?:(?:public|private|protected|readonly)\s+)*({_ID})\??\s*:\s*([^,()=]+)", params):
            if name == "constructor" and parent:
                kind = p[2].strip().split("<")[0]
                self.out.edge("INJECTS", parent, kind, start, props={"injection_type": "constructor"})
                if "Service" in kind or "API" in kind:
                    self.out.edge("CONSUMES_SERVICE", parent, kind, start, props={"service_type": "injected"})
            elif name[:1].isupper() and jsx:
                self.out.edge("USES", ident, p[2].strip().split("<")[0], start, props={"usage": "props"})
        for p in re.finditer(r"\(\s*\{[^}]*\}\s*:\s*([A-Z]\w*)", params):
            if jsx:
                self.out.edge("USES", ident, p[1], start, props={"usage": "props"})
        for p in re.finditer(r"\bnew\s+([A-Z]\w*(?:Service|API)\w*)\s*\(|\binject\(\s*([A-Z]\w*)\s*\)", code):
            self.out.edge("CONSUMES_SERVICE", ident, p[1] or p[2], max(opened, 0) + p.start(), props={"service_type": "created" if p[1] else "injected"})
        return ident

    def run(self) -> list[dict]:
        s, c = self.masked, self.content
        for m in _SPACE.finditer(s):
            end = closing(s, m.end() - 1) + 1
            name = c[m.start("name") : m.end("name")].strip("'\"")
            self.add("Module" if m["kind"] == "module" else "Namespace", name, m.start(), end, calls=False, is_exported=bool(m["export"]), props={"ambient": bool(m["declare"])})
        for m in _CLASS.finditer(s):
            end = closing(s, m.end() - 1) + 1
            heritage = m["heritage"] or ""
            ext = re.search(r"extends\s+([\w$.]+)", heritage)
            impl = re.search(r"implements\s+(.+)", heritage, re.S)
            ident = self.add("Class", m["name"], m.start(), end, calls=False, signature=heritage.strip(), body=c[m.start() : end], is_exported=bool(m["export"]), props={"type_parameters": m["generic"], "default": bool(re.match(r"export\s+default\b", m.group()))})
            self.classes.add(m.start(), end, ident)
            self.generics(ident, m["generic"], m.start())
            if ext:
                self.out.edge("INHERITS", ident, ext[1].rsplit(".", 1)[-1], m.start())
                if ext[1].endswith("Component"):
                    self.out.node("Component", m["name"], m.start(), end, parent_id=ident, props={"framework": "react"})
            for i in re.split(r",(?![^<]*>)", impl[1]) if impl else []:
                self.out.edge("IMPLEMENTS", ident, i.strip().split("<")[0], m.start())
            marks = self.decorators(m.start())
            if "@Component" in marks:
                self.out.node("Component", m["name"], m.start(), end, parent_id=ident, props={"framework": "angular"})
            if "@NgModule" in marks:
                self.out.node("Module", m["name"], m.start(), end, parent_id=ident, props={"framework": "angular"})
            service = "Service" in m["name"] or "API" in m["name"] or "@Injectable" in marks
            at, depth, api = m.end(), 0, []
            for f in _METHOD.finditer(s, m.end(), end - 1):
                depth += s.count("{", at, f.start("name")) - s.count("}", at, f.start("name"))
                at = f.start("name")
                self.defined.add(at)
                if depth or f["name"] in _KEYWORDS - {"constructor"}:
                    continue
                own = self.code(f["name"], f, f.end() - 1, "Method", ident, class_name=m["name"])
                body = next(r for r in reversed(self.out.rows) if r["id"] == own)
                body.setdefault("receiver_type", m["name"])
                if service and T.has(body["body"], _API_WORDS):
                    body["props"]["calls_api"] = "True"
                    api.append(f["name"])
            if service:
                row = next((r for r in self.out.rows if r.get("label") == "Service" and r["parent_id"] == ident), None)
                if row is None:
                    self.out.node("Service", m["name"], m.start(), end, parent_id=ident)
                    row = self.out.rows[-1]
                row["props"] |= {"api_service": "True"} | ({"api_methods": ",".join(api)} if api else {})
        for m in _FUNCTION.finditer(s):
            ident = self.code(m["name"], m, m.end() - 1, "Function", self.spans.innermost(m.start()))
            self.generics(ident, m["generic"], m.start())
        for m in _ARROW.finditer(s):
            after = closing(s, m.start("open")) + 1
            if re.match(r"\s*(?::[^=;]+?)?=>", s[after:]):
                self.code(m["name"], m, m.start("open"), "Function", self.spans.innermost(m.start()), arrow=True)
        for m in _INTERFACE.finditer(s):
            end = closing(s, m.end() - 1) + 1
            ident = self.add("Interface", m["name"], m.start(), end, calls=False, type_definition=c[m.start() : end], is_exported=bool(m["export"]), props={"props_of": m["name"][:-5] if m["name"].endswith("Props") else None})
            self.generics(ident, m["generic"], m.start())
            for e in (m["extends"] or "").split(","):
                if e.strip():
                    self.out.edge("INHERITS", ident, e.strip().split("<")[0], m.start())
            for f in re.finditer(rf"(?:^|[;\n,{{])\s*(?:readonly\s+)?({_ID})(\??)\s*:\s*([^;\n,]+)", s[m.end() - 1 : end - 1]):
                a = m.end() - 1 + f.start(1)
                self.out.node("Prop" if m["name"].endswith("Props") else "Property", f[1], a, a + len(f[1]), parent_id=ident, type_definition=f[3].strip(), props={"required": not f[2]})
                self.out.edge("HAS_PROPS", ident, f[1], a, props={"prop_type": f[3].strip(), "is_required": str(not f[2]).lower()})
        for m in _TYPE.finditer(s):
            stop = re.compile(r";|\n(?=\s*(?:export|type|interface|class|const|let|var|function|import|enum|@|$))").search(s, m.end())
            end = stop.start() if stop else len(s)
            text = c[m.end() : end].strip()
            self.add("Type", m["name"], m.start(), end, calls=False, type_definition=text, is_exported=bool(m["export"]), props={"conditional": bool(re.search(r"extends[^?]+\?", text)), "mapped": bool(re.search(r"\[\s*\w+\s+in\s", text)), "infer": "infer " in text})
        for m in _ENUM.finditer(s):
            end = closing(s, m.end() - 1) + 1
            self.add("Enum", m["name"], m.start(), end, calls=False, type_definition=c[m.start() : end], is_exported=bool(m["export"]))
        self.modules()
        for m in _VARIABLE.finditer(s):
            if not re.match(r"(?:async\s*)?(?:<[^>]*>\s*)?\([^)]*\)\s*(?::[^=]+)?=>|(?:async\s+)?function\b", (m["value"] or "")):
                text = c[m.start("value") : m.end("value")] if m["value"] else None
                self.out.node("Variable", m["name"], m.start(), m.end(), parent_id=self.spans.innermost(m.start()), type_definition=(m["type"] or "").strip() or None, is_exported=bool(m["export"]), props={"value": text, "kind": m["kind"]})
        self.calls()
        for m in re.finditer(rf"path\s*:\s*['\"]([^'\"\n]*)['\"]\s*,\s*component\s*:\s*({_ID})", c):
            route = self.out.node("Route", m[1], m.start(), m.end(), parent_id=self.spans.innermost(m.start()), props={"path": m[1], "component": m[2], "framework": "angular"})
            if m[2] in self.names:
                self.out.edge("HANDLES_ROUTE", self.names[m[2]], route, m.start(), props={"route_path": m[1], "http_method": "GET"})
        for m in re.finditer(r"\b(?:gql|graphql)\s*`\s*(query|mutation|subscription|fragment)?\s*(\w+)?", c):
            self.out.node("APICall", m[2] or m[1] or "query", m.start(), m.end(), parent_id=self.spans.innermost(m.start()), props={"library": "graphql", "operation": m[1] or "query"})
        for m in _JSX.finditer(s):
            owner = self.spans.innermost(m.start())
            el = self.out.node("JSXElement", m[1], m.start(), m.end(), parent_id=owner)
            if owner:
                self.out.edge("RENDERS_JSX", owner, m[1].rsplit(".", 1)[-1], m.start(), props={"jsx_type": "component"})
            for p in re.finditer(r"\s([\w-]+)(?==|\s|$)", m[2]):
                self.out.edge("ACCEPTS_PROPS", el, p[1], m.start())
        self.out.file()
        return self.out.rows

    def modules(self):
        c = self.content
        comments = re.sub(r"/\*.*?\*/|//[^\n]*", lambda x: re.sub(r"[^\n]", " ", x.group()), c, flags=re.S) if "//" in c or "/*" in c else c
        for m in _IMPORT.finditer(comments):
            what = (m["what"] or "").strip()
            kind = "namespace" if what.startswith("*") else "named" if what.startswith("{") else "default" if what else "side_effect"
            names = ",".join(x.strip().split(" as ")[0].removeprefix("type ") for x in re.sub(r"[^{]*\{|\}.*", "", what, flags=re.S).split(",") if x.strip()) if "{" in what else ""
            self.out.node("Import", m["path"], m.start(), m.end(), signature=m.group().strip(), props={"path": m["path"], "type_only": bool(m["type"]), "kind": kind, "names": names or None, "default": what.split(",")[0].strip() if what and what[0] not in "{*" else None})
        for m in _EXPORT_FROM.finditer(comments):
            self.out.node("Export", m["path"], m.start(), m.end(), signature=m.group().strip(), props={"from": m["path"], "re_export": True})
            self.out.edge("RE_EXPORTS", self.path, m["path"], m.start(), props={"export_name": m["what"].strip("{} ")})
        for m in _EXPORT.finditer(self.masked):
            for n in [m["default"]] if m["default"] else m["names"].split(","):
                if n.strip():
                    local, _, alias = n.strip().removeprefix("type ").partition(" as ")
                    alias = alias.strip() or local.strip()
                    self.out.node("Export", alias, m.start(), m.end(), props={"default": bool(m["default"]) or alias == "default", "local": local.strip() if local.strip() != alias else None})
        for m in _DYNAMIC.finditer(comments):
            self.out.edge("DYNAMIC_IMPORT", self.spans.innermost(m.start()) or self.path, m[1], m.start(), props={"import_type": "dynamic"})

    def calls(self):
        suites, cases = Spans(), Spans()
        found = []
        for m in _CALL.finditer(self.masked):
            name = m[1].replace("?.", ".")
            root = name.split(".")[0]
            if root in _KEYWORDS or m.start() in self.defined or re.search(r"(?:function|class|new)\s*\*?\s*$", self.masked[max(0, m.start() - 12) : m.start()]):
                continue
            at, close = m.end() - 1, None
            if self.test_file and root in _SUITES | _CASES | _HOOKS:
                close = closing(self.masked, at) + 1
                title = _string(self.content, at + 1)
                flags = {"skip": ".skip" in name or root[0] == "x", "only": ".only" in name or root[0] == "f" and root != "f", "each": ".each" in name, "async": bool(re.match(r"[^,]*,\s*async\b", self.masked[at:close]))}
                if ".each" in name:
                    second = re.compile(r"\s*\(").match(self.masked, close)
                    if second:
                        title, close = _string(self.content, second.end()), closing(self.masked, second.end() - 1) + 1
                if root in _HOOKS and not re.search(r"=>|\bfunction\b", self.masked[at:close]):
                    pass  # an ordinary call
                elif root in _HOOKS:
                    kind = "setup" if root.startswith(("before", "setup", "suiteSetup")) else "teardown"
                    self.out.node("Fixture", root, m.start(), close, parent_id=suites.innermost(m.start()), test_framework=self.framework, props={"fixture_type": kind})
                elif title:
                    label = "TestSuite" if root in _SUITES else "TestCase"
                    body = self.masked[at:close]
                    counted = {"test_count": len(re.findall(r"\b(?:it|test|specify)(?:\.\w+)*\s*\(", body))} if root in _SUITES else {"assertion_count": len(re.findall(r"\b(?:expect|assert(?:\.\w+)?)\s*\(", body))}
                    ident = self.out.node(label, title, m.start(), close, parent_id=suites.innermost(m.start()), body=self.content[m.start() : close], is_test=True, test_framework=self.framework, test_type=T.first(title.lower(), T.TS_TYPES, "unit"), props=flags, **counted)
                    if (outer := suites.innermost(m.start())):
                        self.out.edge("GROUPS_TESTS" if label == "TestSuite" else "RUNS_TEST", outer, ident, m.start())
                    (suites if root in _SUITES else cases).add(m.start(), close, ident)
                    continue
            found.append((m.start(), at, name))
        for start, at, name in found:
            case = cases.innermost(start)
            owner = case or self.spans.innermost(start)
            root, last = name.split(".")[0], name.rsplit(".", 1)[-1]
            args = self.content[at : closing(self.masked, at) + 1]
            if self.test_file and root in ("expect", "assert"):
                if owner:
                    tail = re.compile(r"((?:\.not)?)\.(\w+)\(([^)]*)\)").match(self.content, closing(self.masked, at) + 1)
                    self.out.node("Assertion", tail[2] if tail else last, start, start + len(name), parent_id=owner, props={"assertion_type": root, "negated": bool(tail and tail[1]), "expected_value": tail and tail[3], "actual_value": args[1:-1]})
                    self.out.edge("ASSERTS", owner, tail[2] if tail else last, start, props={"assertion_type": root})
                continue
            kind = T.first(name, _MOCKS, "")
            if self.test_file and kind:
                target = _string(self.content, at + 1) or args[1:-1].split(",")[0].strip()
                self.out.node("Mock", name, start, start + len(name), parent_id=owner, props={"mock_type": kind, "target_entity": target})
                if owner:
                    self.out.edge("MOCKS", owner, target or name, start, props={"mock_type": kind})
                continue
            if self.test_file and case and (render := next((f for k, f in _RENDERS if last.startswith(k)), None)):
                if jsx := re.match(r"\(\s*<(\w[\w.]*)", args):
                    self.out.edge("TESTS_COMPONENT", case, jsx[1], start, props={"render_method": last, "framework": render})
            if root in ("fetch",) or T.has(name, _API):
                url = _string(self.content, at + 1)
                stated = re.search(r"\bmethod\s*:\s*['\"`](\w+)['\"`]", args)
                method = last.upper() if last in ("get", "post", "put", "delete", "patch") else stated[1].upper() if stated else "GET"
                self.out.node("APICall", name, start, at + len(args), parent_id=owner, props={"url": url, "method": method, "library": root})
                if owner:
                    self.out.edge("CALLS_API", owner, url, start, props={"api_endpoint": url, "http_method": method})
            if r := _ROUTE.search(name):
                url = _string(self.content, at + 1)
                if url:
                    ep = self.out.node("Endpoint", url, start, at + len(args), parent_id=owner, signature=r[1].upper(), props={"http_method": r[1].upper(), "path": url})
                    outer = _outermost(self.masked[at + 1 : at + len(args) - 1])
                    named = re.findall(rf",\s*({_ID})\s*(?=,|$)", outer)
                    inline = re.search(r"=>|\bfunction\b", outer)
                    for k, h in enumerate(named):
                        last_one = k == len(named) - 1 and not inline
                        if not last_one:
                            self.out.node("Middleware", h, start, at + len(args), parent_id=ep)
                        self.handlers.append((h, ep, start, url, r[1].upper(), last_one))
                    if inline:
                        self.out.edge("EXPOSES_ENDPOINT", self.path, ep, start, props={"endpoint_path": url, "endpoint_type": r[1].upper()})
            if re.search(r"(?:app|router)\.use$", name):
                for h in re.findall(rf"(?:^|,)\s*({_ID})\s*(?=,|$|\()", re.sub(r"\)\s*$", "", _outermost(self.masked[at + 1 : at + len(args) - 1], "("))):
                    self.out.node("Middleware", h, start, at + len(args))
                    self.out.edge("USES_MIDDLEWARE", owner or self.path, h, start, props={"middleware_type": "application"})
            if last in ("createContext", "useContext"):
                self.out.node("Hook", last, start, at + len(args), parent_id=owner, props={"kind": "context", "target": args[1:-1].split(",")[0].strip()})
            if last == "defineComponent" or name == "Vue.extend":
                assigned = re.search(rf"({_ID})\s*=\s*$", self.masked[:start])
                self.out.node("Component", assigned[1] if assigned else self.path.rsplit("/", 1)[-1].split(".")[0], start, at + len(args), parent_id=owner, props={"framework": "vue"})
            if owner:
                ref = name.removeprefix("this.")
                self.out.edge("CALLS", owner, ref, start)
                if case and root not in _SUITES | _CASES | _HOOKS and not T.has(name, ("jest.", "vi.", "console.", "screen.", "sinon.")):
                    self.out.edge("TESTS", case, last, start, confidence_score=T.TEST_CONFIDENCE)
                    self.out.edge("COVERS", case, last, start, coverage_type="direct")
        # a route's last name is its handler, those before it are middleware
        for h, ep, start, url, method, is_handler in self.handlers:
            source = self.names.get(h)
            if is_handler:
                self.out.edge("EXPOSES_ENDPOINT", source or self.path, ep, start, props={"endpoint_path": url, "endpoint_type": method} | ({} if source else {"handler": h}))
                if source:
                    self.out.edge("HANDLES_ROUTE", source, ep, start, props={"route_path": url, "http_method": method})
            else:
                self.out.edge("USES_MIDDLEWARE", ep, h, start, props={"middleware_type": "route"})


def extract(path: str, content: str) -> list[dict]:
    return _Scanner(path, content).run()
