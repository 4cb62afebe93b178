"""Facts read from names, calls and lines of source: literals, methods, routes of protocols, names of owners."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Longest literal that is read from a call, in characters.
LITERAL = 512
# Endings of a callee that tell the method of an HTTP call, in order.
HTTP_ENDINGS = {
    ".get": "GET", ".Get": "GET", ".GET": "GET", ".post": "POST", ".Post": "POST", ".POST": "POST", ".put": "PUT", ".Put": "PUT", ".delete": "DELETE", ".Delete": "DELETE",
    ".patch": "PATCH", ".Patch": "PATCH", ".head": "HEAD", ".options": "OPTIONS", "GetAsync": "GET", "PostAsync": "POST", "PutAsync": "PUT", "DeleteAsync": "DELETE",
    "getForObject": "GET", "getForEntity": "GET", "postForObject": "POST", "postForEntity": "POST",
}
# Words that tell the method of an annotated route, in order.
ANNOTATED = ["delete", "patch", "options", "head", "post", "put", "get"]
# Endings of the classes that stand for a gRPC service, in order.
GRPC_ENDINGS = ["BlockingStub", "FutureStub", "AsyncStub", "AsyncClient", "Servicer", "Client", "Stub", "Grpc"]
# Endings of calls of a tRPC procedure, in order.
TRPC_ENDINGS = [".useMutation", ".useQuery", ".subscribe", ".mutation", ".mutate", ".query"]
# Paths that version history leaves out.
UNTRACKED_FOLDERS = [".git/", "node_modules/", "vendor/", "__pycache__/", ".cache/"]
UNTRACKED_NAMES = ["package-lock.json", "yarn.lock", "pnpm-lock.yaml", "Cargo.lock", "poetry.lock", "composer.lock", "Gemfile.lock", "Pipfile.lock"]
UNTRACKED_SUFFIXES = [".lock", ".sum", ".min.js", ".min.css", ".map", ".wasm", ".png", ".jpg", ".gif", ".ico", ".svg"]
_WORD = r"[\p{L}\p{N}_]+"


def _first(pairs: list[tuple[Column, object]]) -> Column:
    out = F.lit(None).cast("string")
    for cond, value in reversed(pairs):
        out = F.when(cond, value if isinstance(value, Column) else F.lit(value)).otherwise(out)
    return out


def _last(c: Column, mark: str = ".") -> Column:
    return F.substring_index(c, mark, -1)


def first_literal(c: Column) -> Column:
    """The first text in quotes, with escapes resolved, cut at LITERAL; null if it is empty or has no end."""
    body = F.regexp_extract(c, r"""(?s)^[^'"`]*(?:'((?:[^'\\]|\\.)*)'|"((?:[^"\\]|\\.)*)"|`((?:[^`\\]|\\.)*)`)""", 0)
    inner = F.regexp_replace(F.regexp_replace(body, r"""(?s)^[^'"`]*['"`]""", ""), r"""(?s).$""", "")
    return F.nullif(F.left(F.regexp_replace(inner, r"(?s)\\(.)", "$1"), F.lit(LITERAL)), F.lit(""))


def http_method(callee: Column) -> Column:
    return _first([(F.endswith(callee, F.lit(end)), method) for end, method in HTTP_ENDINGS.items()])


def annotated_method(line: Column) -> Column:
    """The method of a route annotation, ANY if it names none; null for other lines."""
    low = F.lower(line)
    is_route = F.substr(F.ltrim(line), F.lit(1), F.lit(1)).isin("@", "#", "[") | F.contains(low, F.lit("route(")) | F.contains(low, F.lit("mapping("))
    return F.when(is_route, F.coalesce(_first([(F.contains(low, F.lit(w)), w.upper()) for w in ANNOTATED]), F.lit("ANY")))


def normal_name(c: Column) -> Column:
    """A name with points between its parts, whatever the language's marks, and without marks around it."""
    plain = F.regexp_replace(F.regexp_replace(c, r"""^[\s"'`();]+|[\s"'`();]+$""", ""), r"^(?:new )+", "")
    parts = F.split(F.replace(F.regexp_replace(plain, r"->|::|[\\/]", "."), F.lit("$"), F.lit("")), r"\.")
    return F.array_join(F.filter(parts, lambda x: x != ""), ".")


def binding_key(c: Column) -> Column:
    return _last(normal_name(c))


def parent_name(c: Column) -> Column:
    """What stands before the last point; empty if there is none."""
    return F.when(F.contains(c, F.lit(".")), F.regexp_replace(c, r"\.[^.]*$", "")).otherwise("")


def owner_type(qualified: Column, name: Column) -> Column:
    """The last part of what holds a name."""
    whole, key = normal_name(qualified), binding_key(name)
    ends = (key != "") & F.endswith(whole, F.concat(F.lit("."), key))
    return _last(F.when(ends, F.left(whole, F.length(whole) - F.length(key) - 1)).otherwise(parent_name(whole)))


def call_receiver(callee: Column) -> Column:
    return F.nullif(parent_name(normal_name(callee)), F.lit(""))


def tail_equal(a: Column, b: Column) -> Column:
    """Whether one name is the other, or its last parts."""
    a, b = normal_name(a), normal_name(b)
    dotted = lambda x: F.concat(F.lit("."), x)
    return (a == b) | F.endswith(a, dotted(b)) | F.endswith(b, dotted(a))


def has_suffix(qualified: Column, suffix: Column) -> Column:
    q, s = normal_name(qualified), normal_name(suffix)
    return (q == s) | F.endswith(q, F.concat(F.lit("."), s))


def import_reaches(qualified: Column, module: Column) -> Column:
    """Whether a name lies in a module, or in one of that name inside another."""
    q, m = normal_name(qualified), normal_name(module)
    dot = F.lit(".")
    return F.startswith(q, F.concat(m, dot)) | F.contains(q, F.concat(dot, m, dot)) | F.endswith(q, F.concat(dot, m))


def class_method_tail(c: Column) -> Column:
    """Class and method, the last two parts; null if there are fewer."""
    n = normal_name(c)
    return F.when(F.contains(n, F.lit(".")), F.substring_index(n, ".", -2))


def grpc_method(c: Column) -> Column:
    """Service and method (struct) of the first dotted word that calls a stub or client; null if there is none."""
    words = F.filter(F.split(c, r"""[\s()\[\]{},"']"""), lambda w: F.contains(w, F.lit(".")))
    bare = F.transform(words, lambda w: F.regexp_replace(w, r"^[^\p{L}\p{N}_.]+|[^\p{L}\p{N}_.]+$", ""))

    def one(w):
        method, raw = _last(w), F.regexp_replace(_last(parent_name(w)), "^New", "")
        service = _first([(F.endswith(raw, F.lit(e)), F.left(raw, F.length(raw) - len(e))) for e in GRPC_ENDINGS])
        good = method.rlike(f"^{_WORD}$") & (service != "")
        return F.when(good, F.struct(service.alias("service"), method.alias("method")))

    return F.try_element_at(F.filter(F.transform(bare, one), lambda x: x.isNotNull()), F.lit(1))


def graphql_operation(c: Column) -> Column:
    """The operation a GraphQL text names; null if it names none."""
    body = F.regexp_replace(F.regexp_replace(c, r"^\s+", ""), r"^(?:query|mutation|subscription)\s*", "")
    word = F.regexp_extract(body, r"^[^\s({]*", 0)
    return F.when(word.rlike(f"^{_WORD}$"), word)


def trpc_procedure(callee: Column) -> Column:
    """The procedure of a tRPC call; null if it isn't one."""
    text = F.btrim(callee, F.lit(" \t\r\n"))
    cut = F.coalesce(_first([(F.endswith(text, F.lit(e)), F.left(text, F.length(text) - len(e))) for e in TRPC_ENDINGS]), text)
    own = F.regexp_replace(cut, r"^.*?trpc\.", "")
    return F.when(own.rlike(rf"^{_WORD}(?:\.{_WORD})*$"), own)


def trackable(path: Column) -> Column:
    """Whether history counts a file."""
    folder = suffix = F.lit(False)
    for p in UNTRACKED_FOLDERS:
        folder = folder | F.startswith(path, F.lit(p))
    for s in UNTRACKED_SUFFIXES:
        suffix = suffix | F.endswith(path, F.lit(s))
    return (path != "") & ~folder & ~suffix & ~_last(path, "/").isin(UNTRACKED_NAMES)


def module_proximity(a: Column, b: Column) -> Column:
    """1, and up to a tenth more for the share of folders that two paths begin with in common."""
    slashes = lambda c: F.length(c) - F.length(F.replace(c, F.lit("/"), F.lit("")))
    pa, pb = F.split(a, "/"), F.split(b, "/")
    n = F.least(F.size(pa), F.size(pb)) - 1
    same = F.zip_with(F.slice(pa, F.lit(1), n), F.slice(pb, F.lit(1), n), lambda x, y: x == y)
    shared = F.coalesce(F.nullif(F.array_position(same, F.lit(False)), F.lit(0).cast("long")) - 1, n.cast("long"))
    most = F.greatest(slashes(a), slashes(b))
    return F.when(most == 0, F.lit(1.0)).otherwise(1 + shared / most * 0.1)


def numbered(defs: DataFrame, base: str = "qualified_name", order: str = "start", by: str = "file") -> DataFrame:
    """defs with repeated names of a file told apart: the second is name#2, the third name#3, in definition order."""
    n = F.row_number().over(Window.partitionBy(by, base).orderBy(order))
    return defs.withColumn("__n", n).withColumn(base, F.when(F.col("__n") > 1, F.concat_ws("#", base, F.col("__n").cast("string"))).otherwise(F.col(base))).drop("__n")
