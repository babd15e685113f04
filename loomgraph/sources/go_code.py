"""Go files by a scanner of declarations, bodies and calls."""

from __future__ import annotations

import re

from ..functions import test_rules as T
from .collect import Rows, Spans, closing, doc_comment, mask

_PACKAGE = re.compile(r"^\s*package\s+(\w+)", re.M)
_FUNC = re.compile(r"^func\s*(\([^)]*\))?\s*(\w+)\s*(\[[^\]]*\])?\s*\(", re.M)
_TYPE = re.compile(r"(?:^type\s+|^[ \t]+)(\w+)(\[[^\]]*\])?\s+(=\s*)?(struct|interface)\s*\{|^type\s+(\w+)(\[[^\]]*\])?\s+(=?\s*[^\s({][^\n]*)", re.M)
_IMPORT = re.compile(r"^import\s+(?:\(([^)]*)\)|((?:[\w.]+\s+)?\"[^\"\n]*\"))", re.M)
_CALL = re.compile(r"([A-Za-z_][\w]*(?:\.[A-Za-z_]\w*)*)\s*(?:\[[\w, .*]*\])?\(")
_RECEIVER = re.compile(r"\(\s*\*?\w+\s+\*?(\w+)(?:\[[^\]]*\])?\s*\)")
_KEYWORDS = {"if", "for", "switch", "select", "func", "return", "go", "defer", "range", "case", "else", "type", "var", "const", "struct", "interface", "map", "chan"}
_CHANNEL = re.compile(r"(<-\s*chan|chan\s*<-|chan)\s+([\w.*\[\]{}]+)")
_MAKE = re.compile(r"(\w+)\s*(?::=|=)\s*make\(\s*chan\s+([\w.*\[\]{}]+)\s*(?:,\s*([\w.]+))?\s*\)")
#: A generic type or function with its type arguments; an index is told by its lower-case or numeric place.
_INSTANCE = re.compile(r"\b([A-Z]\w*)\[((?:[\[\]*]*(?:string|bool|byte|rune|error|any|u?int(?:8|16|32|64)?|float(?:32|64)|(?:\w+\.)?[A-Z]\w*)(?:\s*,\s*)?)+)\]\s*[({]")
_BRANCH = re.compile(r"\b(if|for|case|select)\b|&&|\|\|")


def receiver_type(receiver: str) -> tuple[str, bool]:
    """The type named, and whether by pointer."""
    m = _RECEIVER.search(receiver)
    name = m[1] if m else receiver.strip("() ").split(" ")[-1].lstrip("*")
    return name, "*" in receiver


def _signature_end(masked: str, at: int) -> int:
    """Where a body's brace, or the line's end, follows the parameters that open at at."""
    i = closing(masked, at) + 1
    while i < len(masked) and masked[i] not in "{\n":
        if masked[i] in "([":
            i = closing(masked, i)
        elif masked.startswith("interface{", i) or masked.startswith("struct{", i):
            i = closing(masked, masked.index("{", i))
        i += 1
    return i


def extract(path: str, content: str) -> list[dict]:
    masked = mask(content)
    out = Rows(path, content, "go", path.endswith("_test.go"))
    spans = Spans()
    methods: dict[str, list] = {}
    tests: dict[str, bool] = {}
    sends, receives, routines = {}, {}, []
    for m in _FUNC.finditer(masked):
        receiver, name, generic = m[1], m[2], m[3]
        open_body = _signature_end(masked, m.end() - 1)
        has_body = open_body < len(masked) and masked[open_body] == "{"
        end = closing(masked, open_body) + 1 if has_body else open_body
        signature = content[m.start() + 4 : open_body].strip()
        body, code = content[m.start() : end], masked[open_body:end]
        test = T.go_is_test(path, name, signature)
        calls = [c[1] for c in _CALL.finditer(code) if c[1] not in _KEYWORDS]
        more, props = {}, {"receiver": receiver, "type_parameters": generic}
        if receiver:
            more["receiver_type"], pointer = receiver_type(receiver)
            props["pointer_receiver"] = pointer
        if test:
            more |= {"is_test": True, "test_framework": "testing", "test_type": T.go_test_type(name, signature), "test_target": name[4:] if name.startswith("Test") else "", "assertion_count": sum(T.has(c, T.GO_ASSERTIONS) for c in calls)}
            props |= T.flags(body, T.GO_FLAGS)
        label = "TestFunction" if test else "Method" if receiver else "Function"
        ident = out.node(label, name, m.start(), end, signature=signature, body=body, doc_string=doc_comment(content, m.start()), is_exported=name[0].isupper(), complexity=1 + len(_BRANCH.findall(code)), props=props, **more)
        spans.add(m.start(), end, ident)
        if receiver and not test:
            methods.setdefault(more["receiver_type"], []).append((ident, m.start()))
        tests[ident] = test
        for g in re.finditer(r"\[?(\w+)\s+((?:~?[\w.*\[\]]+\s*\|?\s*)+)", (generic or "").strip("[]")):
            out.node("Generic", g[1], m.start(), m.end(), parent_id=ident, type_definition=g[2].strip(), props={"constraint": g[2].strip(), "union": "|" in g[2], "approximate": "~" in g[2]})
        for c in _CALL.finditer(code):
            if c[1] in _KEYWORDS:
                continue
            out.edge("CALLS", ident, c[1], open_body + c.start())
            if test and not T.has(c[1], T.GO_ASSERTIONS) and T.go_production_call(c[1]):
                ref = c[1].rsplit(".", 1)[-1]
                out.edge("TESTS", ident, ref, open_body + c.start(), confidence_score=T.TEST_CONFIDENCE)
                out.edge("COVERS", ident, ref, open_body + c.start(), coverage_type="direct")
        for g in re.finditer(r"\bgo\s+(func\b|[\w.]+)", code):
            routines.append(ident)
            out.edge("USES", ident, "goroutine" if g[1] == "func" else g[1], open_body + g.start(), props={"usage": "concurrency"})
        for g in _MAKE.finditer(code):
            out.node("Variable", g[1], open_body + g.start(), open_body + g.end(), parent_id=ident, type_definition=f"chan {g[2]}", props={"kind": "channel", "element": g[2], "buffer": g[3] or "0"})
        for g in re.finditer(r"(?:^|[\s;{(])(\w+)\s*<-(?!\s*chan)", code):
            sends.setdefault(g[1], []).append(ident)
            out.edge("USES", ident, g[1], open_body + g.start(), props={"usage": "send"})
        for g in re.finditer(r"<-\s*(\w+)(?!\s*chan)|range\s+(\w+)\s*\{", code):
            name_ = g[1] or g[2]
            before = code[: g.start()].rstrip()
            sent = g[1] and re.search(r"[\w)\]]$", before) and not re.search(r"\b(?:return|case)$", before)  # the value of a send
            if name_ != "chan" and not sent:
                receives.setdefault(name_, []).append(ident)
                out.edge("USES", ident, name_, open_body + g.start(), props={"usage": "receive"})
        for g in _INSTANCE.finditer(code):
            out.edge("USES", ident, g[1], open_body + g.start(), props={"usage": "instantiation", "type_arguments": g[2].strip()})
        for g in re.finditer(r"\bselect\s*\{", code):
            out.edge("USES", ident, "select", open_body + g.start(), props={"usage": "select"})

    def named(name, definition, start, end):
        out.node("Class" if definition.startswith("=") else "Type", name, start, end, type_definition=definition.lstrip("= "), is_exported=name[0].isupper(), props={"alias": definition.startswith("=")})

    # types in brackets, besides the structs and interfaces there, which are found with the others
    for m in re.finditer(r"^type\s*\(", masked, re.M):
        for line_at, line in _lines(masked, content, m.end(), closing(masked, m.end() - 1)):
            t = re.match(r"(\w+)(?:\[[^\]]*\])?\s+(=?\s*[^\s(){}][^\n]*)", line)
            if t and masked.count("{", m.end(), line_at) == masked.count("}", m.end(), line_at) and not re.match(r"=?\s*(struct|interface)\b", t[2]):
                named(t[1], t[2].strip(), line_at, line_at + len(line))
    for m in _TYPE.finditer(masked):
        if spans.innermost(m.start()):
            continue
        if m[4]:
            name, kind, opened = m[1], m[4], masked.index("{", m.end() - 1)
            end = closing(masked, opened) + 1
            label = "Struct" if kind == "struct" else "Interface"
            start = m.start() + len(m.group()) - len(m.group().lstrip())
            ident = out.node(label, name, start, end, type_definition=content[opened - len(kind) - 1 : end].strip(), doc_string=doc_comment(content, start), is_exported=name[0].isupper(), props={"type_parameters": m[2]})
            for own, at in methods.get(name, []) if kind == "struct" else []:
                out.edge("DEFINES", ident, own, at)
            for g in re.finditer(r"(\w+)\s+((?:~?[\w.*]+\s*\|?\s*)+)", (m[2] or "").strip("[]")):
                out.node("Generic", g[1], start, end, parent_id=ident, type_definition=g[2].strip(), props={"constraint": g[2].strip(), "union": "|" in g[2], "approximate": "~" in g[2]})
            for line_at, line in _lines(masked, content, opened + 1, end - 1):
                if kind == "struct" and (e := re.fullmatch(r"\*?(?:\w+\.)?(\w+)(?:\[[^\]]*\])?(?:\s*`.*`)?", line)):
                    out.edge("EMBEDS", ident, e[1], line_at)
                elif kind == "struct" and (f := re.match(r"(\w+(?:\s*,\s*\w+)*)\s+(\S.*)", line)):
                    for field in f[1].split(","):
                        out.node("Property", field.strip(), line_at, line_at + len(line), parent_id=ident, type_definition=f[2].split("`")[0].strip(), is_exported=field.strip()[:1].isupper())
                elif kind == "interface" and (f := re.match(r"(\w+)\s*(\(.*)", line)):
                    own = out.node("Method", f[1], line_at, line_at + len(line), parent_id=ident, signature=f[2], receiver_type=name, is_exported=f[1][0].isupper(), props={"abstract": True})
                    out.edge("DEFINES", ident, own, line_at)
                elif kind == "interface" and (e := re.fullmatch(r"(?:\w+\.)?(\w+)", line)):
                    out.edge("EMBEDS", ident, e[1], line_at)
        elif m[5] and not m[7].strip().startswith(("struct", "interface")):
            definition = m[7].strip()
            named(m[5], definition, m.start(), m.end())
    for m in _IMPORT.finditer(re.sub(r"//[^\n]*", lambda x: " " * len(x.group()), content)):
        for i in re.finditer(r"(?:([\w.]+)[ \t]+)?\"([^\"\n]*)\"", m[1] or m[2]):
            out.node("Import", i[2], m.start(), m.start() + i.end(), signature=i.group(), props={"path": i[2], "alias": i[1]})
    for m in _CHANNEL.finditer(masked):
        direction = "receive" if m[1].startswith("<-") else "send" if "<-" in m[1] else "both"
        if masked[max(0, m.start() - 5) : m.start()] != "make(":
            out.node("Type", f"chan {m[2]}", m.start(), m.end(), parent_id=spans.innermost(m.start()), props={"kind": "channel", "direction": direction, "element": m[2]})
    for name, on in _patterns(sends, receives, routines):
        out.node("Type", name, 0, 0, props={"kind": "concurrency_pattern", "evidence": on})
    package = _PACKAGE.search(masked)
    out.file(package and package[1])
    return out.rows


def _lines(masked: str, content: str, a: int, b: int):
    at = a
    for line in masked[a:b].split("\n"):
        text = line.strip().rstrip(",;")
        if text:
            start = at + len(line) - len(line.lstrip())
            yield start, content[start : start + len(text)].strip()
        at += len(line) + 1


def _patterns(sends: dict, receives: dict, routines: list):
    """Worker pool: a channel received from in several places; pipeline: several channels both sent to and received from; fan out and in: many channels and routines."""
    if pools := [c for c, x in receives.items() if len(x) > 1]:
        yield "worker_pool", ",".join(sorted(pools))
    if len(both := sends.keys() & receives.keys()) > 1:
        yield "pipeline", ",".join(sorted(both))
    if len(sends.keys() | receives.keys()) > 2 and len(routines) > 1:
        yield "fan_out_fan_in", str(len(routines))
