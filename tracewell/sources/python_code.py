"""Python source files to feature rows: each file is parsed once, and every view of it comes out as rows of one schema, told apart by `kind`.

A file that can't be parsed gives one row of kind `error`. Further languages register an extractor with the same rows.
"""

from __future__ import annotations

import ast
import hashlib
import io
import re
import tokenize
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Node types that steer control, and those that a function's body histogram counts.
CONTROL = "If For While Try ExceptHandler Raise With AsyncWith AsyncFor Return Yield YieldFrom Match".split()
BODY = (
    "If For While Try ExceptHandler With AsyncWith AsyncFor Return Yield YieldFrom Raise Assign AugAssign AnnAssign Call BoolOp BinOp UnaryOp Compare Lambda "
    "ListComp SetComp DictComp GeneratorExp Subscript Attribute Name Constant FunctionDef AsyncFunctionDef ClassDef Match"
).split()
TRACE = "If For While Try ExceptHandler With Return Raise Break Continue Call BoolOp Compare ListComp Assign".split()
PUBLIC_DUNDERS = "__init__ __call__ __enter__ __exit__ __iter__ __next__ __len__ __repr__ __getitem__ __setitem__ __contains__".split()
#: Numbers in a literal, and characters of a string, from which it is a data table; the length of a shingle of node types.
TABLE_NUMBERS, TABLE_CHARACTERS = 16, 64

SCHEMA = (
    "impl string, path string, pos long, kind string, name string, a string, b string, n long, x double, h map<string,int>, items array<string>, "
    "shape struct<n_pos:int,n_kw:int,n_def:int,va:boolean,kw:boolean,n_ann:int>, depth int, arity int, ret int, loop int, cyc int, tot int"
)
_COLUMNS = [f.split()[0] for f in re.sub(r"struct<[^>]*>|map<[^>]*>|array<[^>]*>", "t", SCHEMA).split(", ")]
_FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)
_NESTING = (ast.If, ast.For, ast.While, ast.Try, ast.With, ast.AsyncFor, ast.AsyncWith)
_DOCUMENTED = (ast.Module, ast.ClassDef, *_FUNCTIONS)


def _kind(node: ast.AST) -> str:
    return type(node).__name__


def _preorder(node: ast.AST) -> Iterator[ast.AST]:
    stack = [node]
    while stack:
        at = stack.pop()
        yield at
        stack.extend(reversed(list(ast.iter_child_nodes(at))))


def _height(node: ast.AST, counts: Callable[[ast.AST], bool]) -> int:
    """The largest number of counted nodes on a way down from node, itself not among them."""
    best, stack = 0, [(node, 0)]
    while stack:
        at, depth = stack.pop()
        best = max(best, depth)
        stack.extend((c, depth + counts(c)) for c in ast.iter_child_nodes(at))
    return best


def _callee(call: ast.Call) -> str | None:
    f = call.func
    return f.id if isinstance(f, ast.Name) else f.attr if isinstance(f, ast.Attribute) else None


def signature_shape(f: ast.FunctionDef | ast.AsyncFunctionDef) -> dict:
    """Counts of a signature; annotations of positional-only arguments aren't counted."""
    a = f.args
    named = [*a.args, *a.kwonlyargs, *filter(None, (a.vararg, a.kwarg))]
    return {
        "n_pos": len(a.posonlyargs) + len(a.args), "n_kw": len(a.kwonlyargs), "n_def": len(a.defaults) + sum(d is not None for d in a.kw_defaults),
        "va": a.vararg is not None, "kw": a.kwarg is not None, "n_ann": sum(x.annotation is not None for x in named),
    }


def _scoped(body: list[ast.stmt], scope: tuple[str, ...], into_functions: bool) -> Iterator[tuple[tuple[str, ...], ast.AST]]:
    """(scope, function) of the functions that stand in a body, in its compound statements and classes, and if asked in its functions."""
    for node in body:
        if isinstance(node, _FUNCTIONS):
            yield scope, node
            if into_functions:
                yield from _scoped(node.body, (*scope, node.name), True)
        elif isinstance(node, ast.ClassDef):
            yield from _scoped(node.body, (*scope, node.name), into_functions)
        else:
            inner = [c for c in ast.iter_child_nodes(node) if isinstance(c, (ast.stmt, ast.excepthandler, ast.match_case))]
            yield from _scoped(inner, scope, into_functions)


def _call_rows(tree: ast.Module, module: str) -> Iterator[dict]:
    """Calls by qualified callers: functions of modules and classes are nodes, what they nest is theirs."""
    for scope, f in _scoped(tree.body, (module,), False):
        name = ".".join((*scope, f.name))
        yield {"kind": "call_fn", "name": name}
        for statement in f.body:
            for node in ast.walk(statement):
                if isinstance(node, ast.Call) and (callee := _callee(node)):
                    yield {"kind": "call_edge", "a": name, "b": callee}


def _name_rows(tree: ast.Module) -> Iterator[dict]:
    """Calls by the innermost function's bare name."""
    stack: list[tuple[ast.AST, str | None]] = [(tree, None)]
    while stack:
        node, inside = stack.pop()
        if isinstance(node, _FUNCTIONS):
            yield {"kind": "name_def", "name": node.name}
            inside = node.name
        elif isinstance(node, ast.Call) and inside and (callee := _callee(node)):
            yield {"kind": "name_call", "a": inside, "b": callee}
        stack.extend((c, inside) for c in ast.iter_child_nodes(node))


def _function_rows(tree: ast.Module, module: str) -> Iterator[dict]:
    catalogue = set(BODY)
    for scope, f in _scoped(tree.body, (module,), True):
        seen = Counter(_kind(n) for s in f.body for n in ast.walk(s))
        depth = max(1 + _height(s, lambda _: True) for s in f.body)
        yield {"kind": "shape", "name": ".".join((*scope, f.name)), "a": f.name, "shape": signature_shape(f), "h": {k: v for k, v in seen.items() if k in catalogue}, "depth": depth, "n": len(f.body)}
    for f in (n for n in ast.walk(tree) if isinstance(n, _FUNCTIONS)):
        yield {"kind": "pilot_fn", "name": f.name, "shape": signature_shape(f), "h": dict(Counter(_kind(n) for s in f.body for n in ast.walk(s)))}
        yield {"kind": "stream", "name": f.name, "items": [_kind(n) for n in _preorder(f)]}


def trace_descriptor(f: ast.AST) -> dict:
    """Control histogram, arity, size, complexity, nesting, returns and loops of a function."""
    h = Counter(k for k in map(_kind, ast.walk(f)) if k in TRACE)
    a = f.args
    return {
        "h": dict(h), "arity": len(a.args) + len(a.kwonlyargs) + (a.vararg is not None) + (a.kwarg is not None), "tot": h.total(),
        "cyc": 1 + sum(h[k] for k in ("If", "For", "While", "ExceptHandler", "BoolOp")), "depth": _height(f, lambda c: isinstance(c, _NESTING)), "ret": h["Return"], "loop": h["For"] + h["While"],
    }


def _trace_rows(tree: ast.Module) -> Iterator[dict]:
    """Descriptors of functions outside functions; those without any counted node are left out."""
    for scope, f in _scoped(tree.body, (), False):
        d = trace_descriptor(f)
        if d["tot"]:
            yield {"kind": "trace", "name": ".".join((*scope[-1:], f.name)), **d}


def skeleton(f: ast.AST, most: int = 34) -> list[str]:
    """Statement types of a function, indented by depth, without any identifier; at most `most` lines."""
    out: list[str] = []
    stack = [(s, 0) for s in reversed(f.body)]
    while stack and len(out) < most:
        node, depth = stack.pop()
        out.append("  " * depth + _kind(node))
        stack.extend((c, depth + 1) for c in reversed(list(ast.iter_child_nodes(node))) if isinstance(c, (ast.stmt, ast.excepthandler)))
    return out


def _numbers(nodes: list) -> list:
    return [n.value for n in nodes if isinstance(n, ast.Constant) and isinstance(n.value, (int, float))]


def _literal_rows(tree: ast.Module) -> Iterator[dict]:
    """Data tables by digest, unusual floats, string constants (messages are told from them by column rules)."""
    digest = lambda v: hashlib.blake2b(repr(v).encode("utf-8", "surrogatepass"), digest_size=12).hexdigest()
    for n in ast.walk(tree):
        if isinstance(n, (ast.List, ast.Tuple, ast.Set, ast.Dict)):
            values = _numbers(n.keys if isinstance(n, ast.Dict) else n.elts)
            if len(values) >= TABLE_NUMBERS:
                yield {"kind": "table", "name": digest(tuple(values))}
        elif isinstance(n, ast.Constant):
            v = n.value
            if isinstance(v, (str, bytes)) and len(v) >= TABLE_CHARACTERS:
                yield {"kind": "table", "name": digest(v)}
            if isinstance(v, float) and v not in (0.0, 1.0):
                yield {"kind": "float", "x": round(v, 6)}
            if isinstance(v, str) and v.isprintable():
                yield {"kind": "string", "name": v}


def _name_set_rows(tree: ast.Module, text: str) -> Iterator[dict]:
    names, docs = set(), []
    for n in ast.walk(tree):
        if isinstance(n, ast.Name):
            names.add(n.id)
        elif isinstance(n, ast.Attribute):
            names.add(n.attr)
        elif isinstance(n, ast.arg):
            names.add(n.arg)
        elif isinstance(n, (ast.ClassDef, *_FUNCTIONS)):
            names.add(n.name)
        if isinstance(n, _DOCUMENTED) and (doc := ast.get_docstring(n)):
            docs.append(doc)
        if isinstance(n, ast.Import):
            yield from ({"kind": "import", "name": x.name.split(".")[0]} for x in n.names)
        elif isinstance(n, ast.ImportFrom) and n.module and not n.level:
            yield {"kind": "import", "name": n.module.split(".")[0]}
    yield from ({"kind": "ident", "name": x} for x in sorted(names))
    yield from ({"kind": "doc", "name": x} for x in docs)
    try:
        yield from ({"kind": "comment", "name": t.string} for t in tokenize.generate_tokens(io.StringIO(text).readline) if t.type == tokenize.COMMENT)
    except (tokenize.TokenError, SyntaxError):
        pass
    yield from ({"kind": "api", "name": x} for x in sorted(public_names(tree)))


def exported(tree: ast.Module) -> set[str]:
    """The strings of a literal __all__."""
    out = set()
    for n in tree.body:
        if isinstance(n, ast.Assign) and isinstance(n.value, (ast.List, ast.Tuple)) and any(isinstance(t, ast.Name) and t.id == "__all__" for t in n.targets):
            out |= {e.value for e in n.value.elts if isinstance(e, ast.Constant) and isinstance(e.value, str)}
    return out


def public_names(tree: ast.Module) -> set[str]:
    """Names that an interface dictates: public functions, classes and methods of the module, and its exports."""
    top = [n for n in tree.body if isinstance(n, (ast.ClassDef, *_FUNCTIONS)) and not n.name.startswith("_")]
    inner = [m.name for c in top if isinstance(c, ast.ClassDef) for m in c.body if isinstance(m, _FUNCTIONS) and not m.name.startswith("_")]
    return exported(tree) | {n.name for n in top} | set(inner)


def file_rows(path: str, text: str) -> Iterator[dict]:
    """Every view of one file."""
    try:
        tree = ast.parse(text)
        module = re.sub(r"\.py$", "", path).replace("/", ".")
        seen = Counter(_kind(n) for n in ast.walk(tree))
        rows = [*({"kind": "node", "name": k, "n": v} for k, v in seen.items()), *({"kind": "control", "name": k, "n": v} for k, v in seen.items() if k in CONTROL)]
        for view in (_call_rows(tree, module), _name_rows(tree), _function_rows(tree, module), _trace_rows(tree), _literal_rows(tree), _name_set_rows(tree, text)):
            rows += view
    except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
        rows = [{"kind": "error", "name": type(e).__name__}]
    yield from rows


EXTRACTORS: dict[str, Callable[[str, str], Iterator[dict]]] = {"python": file_rows}


def extract(files: DataFrame, language: str = "python") -> DataFrame:
    """files(impl, path, text) to feature rows of SCHEMA; a file is parsed once, where it is. Persist the result before taking several views of it."""
    rows_of = EXTRACTORS[language]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            for impl, path, text in zip(df["impl"], df["path"], df["text"]):
                rows = [{"impl": impl, "path": path, "pos": i, **r} for i, r in enumerate(rows_of(path, text or ""))]
                yield pd.DataFrame.from_records(rows, columns=_COLUMNS).astype(object).where(lambda x: x.notna(), None)

    return files.select("impl", "path", "text").mapInPandas(run, SCHEMA)


def view(features: DataFrame, kind: str) -> DataFrame:
    return features.where(F.col("kind") == kind)


# --- interfaces: they need all files of an implementation together, which is one package ---


def normalise_annotation(text: str | None) -> str | None:
    """Optional[X] as X | None and Union[A, B] as A | B, at any depth; white space collapsed."""
    if text is None:
        return None

    def show(node: ast.AST) -> str:
        if isinstance(node, ast.Subscript):
            name = _callee(ast.Call(node.value, [], []))
            parts = node.slice.elts if isinstance(node.slice, ast.Tuple) else [node.slice]
            if name == "Optional":
                return f"{show(node.slice)} | None"
            if name == "Union":
                return " | ".join(map(show, parts))
            return f"{ast.unparse(node.value)}[{', '.join(map(show, parts))}]"
        if isinstance(node, ast.BinOp) and isinstance(node.op, ast.BitOr):
            return f"{show(node.left)} | {show(node.right)}"
        return ast.unparse(node)

    try:
        return show(ast.parse(" ".join(text.split()), mode="eval").body)
    except (SyntaxError, ValueError):
        return " ".join(text.split())


def describe_method(f: ast.FunctionDef | ast.AsyncFunctionDef) -> dict:
    a, s = f.args, signature_shape(f)
    named = [x.arg for x in a.args]
    named = named[1:] if named[:1] in (["self"], ["cls"]) else named
    raised = set()
    for n in (n for n in ast.walk(f) if isinstance(n, ast.Raise)):
        exc = n.exc.func if isinstance(n.exc, ast.Call) else n.exc
        raised.add("<bare-reraise>" if exc is None else exc.id if isinstance(exc, ast.Name) else exc.attr if isinstance(exc, ast.Attribute) else "")
    return {
        "pos_args": named, "kw_args": [x.arg for x in a.kwonlyargs], "n_pos": len(named), "n_kw": len(a.kwonlyargs), "pos_defaults": len(a.defaults), "kw_defaults": sum(d is not None for d in a.kw_defaults),
        "va": s["va"], "kw": s["kw"], "returns": normalise_annotation(ast.unparse(f.returns) if f.returns else None), "raised": sorted(raised - {""}),
    }


METHOD = "struct<pos_args:array<string>,kw_args:array<string>,n_pos:int,n_kw:int,pos_defaults:int,kw_defaults:int,va:boolean,kw:boolean,returns:string,raised:array<string>>"
METHOD_SHAPE = ["n_pos", "n_kw", "pos_defaults", "kw_defaults", "va", "kw", "returns", "raised"]
SIGNATURE = "struct<kind:string,args:array<string>,n_pos:int,n_kw:int,n_def:int,returns:boolean>"
SIGNATURE_SHAPE = ["kind", "n_pos", "n_kw", "n_def", "returns"]


def class_attributes(c: ast.ClassDef) -> list[str]:
    """Public names assigned in a class's body, or to self in its __init__."""
    out = set()

    def targets(n: ast.AST) -> list[ast.AST]:
        return n.targets if isinstance(n, ast.Assign) else [n.target] if isinstance(n, ast.AnnAssign) else []

    for n in c.body:
        out |= {t.id for t in targets(n) if isinstance(t, ast.Name)}
        if isinstance(n, _FUNCTIONS) and n.name == "__init__":
            out |= {t.attr for m in ast.walk(n) for t in targets(m) if isinstance(t, ast.Attribute) and isinstance(t.value, ast.Name) and t.value.id == "self"}
    return sorted(x for x in out if not x.startswith("_"))


def public_methods(c: ast.ClassDef) -> dict[str, ast.AST]:
    return {n.name: n for n in c.body if isinstance(n, _FUNCTIONS) and (not n.name.startswith("_") or n.name in PUBLIC_DUNDERS)}


def interface_rows(package: str, files: dict[str, str]) -> Iterator[dict]:
    """What a package exports: `symbol` rows with signatures, `method` rows with descriptors, `attributes` rows.

    Symbols follow absolute module paths only; classes follow relative imports of the package too.
    """
    parsed: dict[str, ast.Module | None] = {}

    def module(path: str) -> ast.Module | None:
        if path not in parsed:
            try:
                parsed[path] = ast.parse(files[path]) if path in files else None
            except (SyntaxError, ValueError, RecursionError):
                parsed[path] = None
        return parsed[path]

    init = next((t for p in (f"{package}/__init__.py", f"src/{package}/__init__.py") if (t := module(p))), None)
    if init is None:
        return
    names = exported(init)
    origin = {x.asname or x.name: (n.module, n.level) for n in init.body if isinstance(n, ast.ImportFrom) and n.module for x in n.names}

    def top(name: str, relative: bool, first: str) -> ast.AST | None:
        found = [n for n in init.body if isinstance(n, (ast.ClassDef, ast.FunctionDef)) and n.name == name]
        if not found and name in origin:
            dotted, level = origin[name]
            dotted = f"{package}.{dotted}" if relative and level else dotted
            bases = ("src/", "") if first == "src" else ("", "src/")
            for tree in filter(None, (module(f"{b}{dotted.replace('.', '/')}.py") for b in bases)):
                found = [n for n in tree.body if isinstance(n, (ast.ClassDef, ast.FunctionDef)) and n.name == name]
                if found:
                    break
        return found[0] if found else None

    for name in sorted(names):
        node = top(name, False, "src")
        if isinstance(node, ast.FunctionDef):
            a = node.args
            sig = {"kind": "function", "args": [x.arg for x in a.args], "n_pos": len(a.args), "n_kw": len(a.kwonlyargs), "n_def": len(a.defaults) + sum(d is not None for d in a.kw_defaults), "returns": node.returns is not None}
        else:
            sig = {"kind": "class" if node is not None else "unknown", "args": [], "n_pos": 0, "n_kw": 0, "n_def": 0, "returns": False}
        yield {"kind": "symbol", "cls": "", "method": name, "sig": sig}
        c = top(name, True, "root")
        if isinstance(c, ast.ClassDef):
            yield {"kind": "attributes", "cls": name, "items": class_attributes(c)}
            yield from ({"kind": "method", "cls": name, "method": m, "d": describe_method(f)} for m, f in sorted(public_methods(c).items()))


INTERFACE = f"impl string, kind string, cls string, method string, sig {SIGNATURE}, d {METHOD}, items array<string>"


def interfaces(files: DataFrame) -> DataFrame:
    """files(impl, package, path, text) to interface rows; an implementation is one package, held by one task."""

    def run(key: tuple, df: pd.DataFrame) -> pd.DataFrame:
        rows = [{"impl": key[0], **r} for r in interface_rows(key[1], dict(zip(df["path"], df["text"])))]
        return pd.DataFrame.from_records(rows, columns=["impl", "kind", "cls", "method", "sig", "d", "items"]).astype(object).where(lambda x: x.notna(), None)

    return files.groupBy("impl", "package").applyInPandas(run, INTERFACE)


def classify_imports(imports: DataFrame, listing: DataFrame, packages: DataFrame, stdlib: list[str]) -> DataFrame:
    """(impl, name, origin, rule) by the first rule that holds: standard library, the package itself, a module in the package, a module elsewhere in the tree, third party.

    imports: (impl, name); listing: (impl, path) of all files; packages: (impl, package).
    """
    parts = F.split(F.regexp_replace("path", "^src/", ""), "/")
    module = listing.select("impl", parts.alias("p")).where(F.size("p") <= 3)
    leaf = F.regexp_replace(F.element_at("p", -1), r"\.py$", "")
    init = F.element_at("p", -1) == "__init__.py"
    named = module.select("impl", F.when(init & (F.size("p") > 1), F.try_element_at("p", F.lit(-2))).otherwise(leaf).alias("name"), F.when(init, F.size("p") - 1).otherwise(F.size("p")).alias("depth"), F.element_at("p", 1).alias("top"))
    hidden = F.col("top").startswith(".") | F.col("top").isin("__pycache__", "build", "dist", "tests", "test", "docs")
    found = named.where("depth <= 2").join(packages, "impl").select("impl", "name", ((F.col("top") == F.col("package")) & (F.col("depth") == 2)).alias("sibling"), (F.col("depth") == 1).alias("root"), hidden.alias("hidden"))
    found = found.groupBy("impl", "name").agg(F.max("sibling").alias("sibling"), F.max(F.col("root") | ~F.col("hidden")).alias("inside"))
    rows = imports.select("impl", "name").distinct().join(packages, "impl").join(found, ["impl", "name"], "left")
    rule = F.when(F.col("name").isin(stdlib), "R1_stdlib").when(F.col("name") == F.col("package"), "R2_first_party_self").when(F.col("sibling"), "R3_first_party_sibling").when(F.col("inside"), "R4_internal_helper").otherwise("R5_third_party_kept")
    origins = {"R1_stdlib": "stdlib", "R2_first_party_self": "first_party_self", "R3_first_party_sibling": "sibling_package", "R4_internal_helper": "internal_helper", "R5_third_party_kept": "third_party"}
    out = rows.select("impl", "name", rule.alias("rule"))
    return out.withColumn("origin", F.create_map(*[F.lit(x) for kv in origins.items() for x in kv])[F.col("rule")])
