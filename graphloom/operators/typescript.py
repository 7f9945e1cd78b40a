"""Symbols, calls and type uses of TypeScript and JavaScript files.

Each file is lexed once in an Arrow batch: comments, strings and regular expressions are blanked, so
that braces and words left are code; declarations are then found by position and depth. It is no
full syntax tree: names are resolved within the file and through its imports only.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from graphloom.sources.files import language

MOST_COMPLEX = 50
_FACTS = (
    "repo_url string, path string, kind string, id string, name string, owner string, target string, resolved boolean, "
    "line_start long, line_end long, is_exported boolean, is_async boolean, is_static boolean, visibility string, complexity long"
)
_ID = r"[A-Za-z_$][\w$]*"
_QUOTED = re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|'(?:[^'\\\n]|\\.)*'?|\"(?:[^\"\\\n]|\\.)*\"?|`|/|[{}]", re.S)
_REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[A-Za-z]*")
_TEMPLATE = re.compile(r"(?:[^`\\$]|\\.|\$(?!\{))*", re.S)
_BEFORE_REGEX = re.compile(r"(?:^|[(,=:\[!&|?{};+*%<>~^-]|\b(?:return|typeof|case|in|of|void|delete))\s*$")
_DECLARED = re.compile(
    rf"(?<![\w$.])(?P<export>export\s+)?(?:default\s+)?(?:declare\s+)?(?:"
    rf"(?P<async>async\s+)?function\s*\*?\s*(?P<function>{_ID})"
    rf"|(?:abstract\s+)?class\s+(?P<class>{_ID})"
    rf"|(?:interface|(?:const\s+)?enum|type(?=\s+{_ID}\s*[<=]))\s+(?P<type>{_ID})"
    rf"|(?:const|let|var)\s+(?P<value>{_ID})\s*(?::[^=;]*?)?=\s*(?P<async2>async\b\s*)?(?=function\b|{_ID}\s*=>|<[^()]*>\s*\(|\())"
)
_METHOD = re.compile(rf"(?<![\w$.@])(?P<flags>(?:(?:public|private|protected|static|async|override|readonly|abstract|get|set)\s+)*)(?:\*\s*)?(?P<name>#?{_ID})\s*(?:<[^()]*>)?\s*(?P<open>\()")
_CALL = re.compile(rf"(?<![\w$.#])(?:(?P<receiver>{_ID})\s*\??\.\s*)?(?P<name>{_ID})\s*(?:<[\w\s,.\[\]]*>)?\s*(?:\?\.)?\(")
_BRANCH = re.compile(r"(?<![\w$.])(?:if|for|while|do|case|catch)(?![\w$])|&&(?!=)|\|\|(?!=)|(?<!\?)\?(?![?.:,)=])")
_IMPORT = re.compile(r"(?<![\w$.])import\s+(?:type\s+)?([^;'\"]*?)\s*\bfrom(?![\w$])")
_MODULE = re.compile(r"\s*(['\"])([^'\"\n]+)\1")
_CONTINUES = re.compile(r"\s*(?:=>|[{.:|&?<(]|extends\b|implements\b)")
_UNFINISHED = re.compile(r"(?:=>|[=:|&,<]|\b(?:extends|implements|function|class))\s*$")
_TYPE = re.compile(r":\s*((?:[^=:;{}(),<>]|<[^<>]*(?:<[^<>]*>[^<>]*)*>)+)")
_NO_CALLS = frozenset("if for while switch catch return typeof new function await super import do else case void delete in of yield".split())


def blanked(text: str) -> str:
    """The text with comments, strings and regular expressions as blanks; lengths and line ends stay."""
    out, at, nested = [], 0, []  # nested: open braces since each `${`

    def skip(to: int) -> None:
        nonlocal at
        out.append(re.sub(r"[^\n]", " ", text[at:to]))
        at = to

    while m := _QUOTED.search(text, at):
        out.append(text[at : m.start()])
        at, what = m.start(), m.group()
        if what == "{" or what == "}" and not (nested and nested[-1] == 0):
            if nested:
                nested[-1] += 1 if what == "{" else -1
            out.append(what)
            at += 1
            continue
        if what == "/":
            r = _REGEX.match(text, at)
            if r and _BEFORE_REGEX.search(text, max(0, at - 40), at):
                skip(r.end())
            else:
                out.append(what)
                at += 1
            continue
        if what in "`}":  # a template, or the end of a hole in one
            if what == "}":
                nested.pop()
            end = _TEMPLATE.match(text, at + 1).end()
            hole = text.startswith("${", end)
            skip(min(len(text), end + (2 if hole else 1)))
            if hole:
                nested.append(0)
            continue
        skip(m.end())
    out.append(text[at:])
    return "".join(out)


def _pairs(code: str) -> tuple[dict[int, int], list[int], list[int]]:
    """(closing place of each opening bracket, places where the depth changes, depth from there on)."""
    close, places, depth, stack = {}, [0], [0], []
    for m in re.finditer(r"[(){}\[\]]", code):
        if m.group() in "([{":
            stack.append(m.start())
        elif stack:
            close[stack.pop()] = m.start()
        places.append(m.start() + (m.group() in "([{"))
        depth.append(len(stack))
    close.update((i, len(code)) for i in stack)
    return close, places, depth


def _body(code: str, at: int, close: dict[int, int], block: bool = True) -> tuple[int, int]:
    """(start of the body or end, end) of what is declared before `at`: to its block's end (if `block`), else to the statement's."""
    i = at
    while i < len(code):
        c = code[i]
        if c == "{" and block:
            return i, close[i] + 1
        if c in "([{":
            i = close[i]
        elif c == ";" or c == "}" or (c == "\n" and not _CONTINUES.match(code, i) and not _UNFINISHED.search(code[max(at - 1, i - 40) : i])):
            return i, i
        i += 1
    return i, i


def symbols_of(text: str, file_id: str, path: str) -> list[dict]:
    """The facts of one file, as dicts of the columns after `path`."""
    code = blanked(text)
    close, places, depth = _pairs(code)
    at_depth = lambda i: depth[bisect_right(places, i) - 1]
    starts = [0, *(m.end() for m in re.finditer("\n", code))]
    line = lambda i: bisect_right(starts, i)
    repo = file_id[: -len(path) - 1]
    facts, spans = [], []  # spans: (fact, signature's place, body's place, end, class)

    imported = {}
    for m in _IMPORT.finditer(code):
        if module := _MODULE.match(text, m.end()):
            imported |= dict.fromkeys(re.findall(rf"({_ID})\s*(?=[,}}]|$)", m.group(1).strip()), module.group(2))

    def add(kind: str, prefix: str, name: str, start: int, end: int, **more) -> dict:
        fact = {"kind": kind, "id": f"{repo}:{prefix}:{path}:{name}@{line(start)}", "name": name, "line_start": line(start), "line_end": line(max(start, end - 1)), **more}
        facts.append(fact)
        return fact

    functions, classes, methods, types = {}, {}, {}, {}
    for m in _DECLARED.finditer(code):
        if at_depth(m.start()):
            continue
        exported = bool(m["export"])
        if m["class"]:
            brace, end = _body(code, m.end(), close)
            base = re.search(rf"\bextends\s+({_ID}(?:\.{_ID})*)", code[m.end() : brace])
            fact = add("Class", "cls", m["class"], m.start(), end, is_exported=exported, base=base and base.group(1))
            classes.setdefault(m["class"], fact["id"])
            own = methods.setdefault(fact["id"], {})
            spans.append((fact, brace, brace, brace, fact["id"]))  # fields and constructor are added below
            level, i = at_depth(m.start()) + 1, brace + 1
            while brace < len(code) and (f := _METHOD.search(code, i, end)):
                i = f.start() + 1
                if at_depth(f.start()) != level or not re.search(r"(?:[{};\n)]|\*/)\s*$", code[max(0, f.start() - 60) : f.start()]):
                    continue
                after = close[f.start("open")] + 1
                block = re.compile(r"\s*(?::(?:[^{};=]|\{[^{}]*\}(?=\s*[{|&\[>]))*)?\{").match(code, after, end)
                if not block:
                    continue
                opened = block.end() - 1
                stop = close[opened] + 1
                if f["name"] == "constructor":
                    spans.append((fact, f.start(), opened, stop, fact["id"]))
                elif f["name"] not in _NO_CALLS:
                    flags = f["flags"].split()
                    seen = next((x for x in ("private", "protected") if x in flags), "private" if f["name"].startswith("#") else "public")
                    method = add("Method", "method", f["name"], f.start(), stop, owner=fact["id"], is_async="async" in flags, is_static="static" in flags, visibility=seen)
                    own.setdefault(f["name"], method["id"])
                    spans.append((method, f.start(), opened, stop, fact["id"]))
                i = stop
        elif m["type"]:
            _, end = _body(code, m.end(), close, block=code[m.start("type") - 5 : m.start("type")].strip() != "type")
            types.setdefault(m["type"], add("TypeDef", "type", m["type"], m.start(), end, is_exported=exported)["id"])
        else:
            name, at = m["function"] or m["value"], m.end()
            if m["value"]:
                arrow = re.compile(r"function\b").match(code, at) or re.compile(rf"(?:<[^()]*>\s*)?(?:{_ID}|(?=\())").match(code, at)
                opened = code.find("(", at)
                if code[arrow.end() : arrow.end() + 1] == "(" or code.startswith("function", at):
                    rest = close.get(opened, len(code)) + 1
                    if not code.startswith("function", at) and not re.compile(r"\s*(?::[^;]*?)?=>").match(code, rest):
                        continue  # a bracketed value, no function
            brace, end = _body(code, at, close)
            fact = add("Function", "fn", name, m.start(), end, is_exported=exported, is_async=bool(m["async"] or m["async2"]))
            functions.setdefault(name, fact["id"])
            spans.append((fact, m.start(), brace, end, None))

    def edge(kind: str, source: str, target: str | None, resolved: bool) -> None:
        if target and (kind, source, target) not in known:
            known.add((kind, source, target))
            facts.append({"kind": kind, "owner": source, "target": target, "resolved": resolved})

    known: set = set()
    for fact, sign, brace, end, cls in spans:
        body = code[brace:end] or code[sign:end]
        if fact["kind"] != "Class":
            loops = len(re.findall(r"(?<![\w$.])do(?![\w$])", body))  # the `while` of a `do` is no branch of its own
            fact["complexity"] = min(MOST_COMPLEX, 1 + len(_BRANCH.findall(body)) - loops)
        elif (base := fact.pop("base", None)) and end == brace:
            head = base.split(".")[0]
            edge("EXTENDS", fact["id"], classes.get(base) or (head in imported and f"{base.split('.')[-1]}@{imported[head]}") or None, base in classes)
        for c in _CALL.finditer(code, brace, end):
            name, receiver = c["name"], c["receiver"]
            if name in _NO_CALLS or re.search(r"\b(?:function|new)\s*$", code[max(0, c.start() - 12) : c.start()]):
                continue
            if receiver == "this":
                edge("CALLS", fact["id"], methods.get(cls, {}).get(name), True)
            elif receiver:
                edge("CALLS", fact["id"], f"{name}@{imported[receiver]}" if receiver in imported else None, False)
            elif name in functions:
                edge("CALLS", fact["id"], functions[name], True)
            elif name in imported:
                edge("CALLS", fact["id"], f"{name}@{imported[name]}", False)
        for spot in _TYPE.finditer(code, sign, brace):
            for name in re.findall(rf"(?<![\w$.]){_ID}", spot.group(1)):
                local = classes.get(name) or types.get(name)
                edge("USES_TYPE", fact["id"], local or (f"{name}@{imported[name]}" if name in imported else None), bool(local))
    for fact in facts:
        fact.pop("base", None)
    return facts


def typescript_facts(files: DataFrame) -> DataFrame:
    """Symbols (Function, Class, Method, TypeDef) and edges (CALLS, USES_TYPE, EXTENDS) of files(repo_url, path, content).

    Edges have `owner` as source; a target that only an import names is `name@module` and not resolved.
    Null and empty contents give no rows, unclosed brackets end with the file.
    """
    rows = files.where(language(F.col("path")).isin("typescript", "javascript") & F.col("content").isNotNull()).select("repo_url", "path", "content")
    fields = StructType.fromDDL(_FACTS)

    def run(batches) -> Iterator:
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(fields)
        for b in batches:
            found = []
            for repo, path, content in zip(*(b.column(i).to_pylist() for i in range(3))):
                found += [{**dict.fromkeys(fields.names), **fact, "repo_url": repo, "path": path} for fact in symbols_of(content, f"{repo}:{path}", path)]
            yield pa.RecordBatch.from_pylist(found, schema=schema)

    return rows.mapInArrow(run, fields)
