"""Line search attributed to the tightest span, tokens, document frequency and TF-IDF."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plexloom.operators.traverse import cut

MATCH_LINES, RAW, CODE_LIMIT = 64, 20, 200
#: Lines of a block by which lines and spans are joined.
BLOCK = 256
#: Lines of a long symbol that are shown, and how far before its first match they begin.
FULL_LINES, FULL_LEAD = 60, 5


def glob_regex(glob: str) -> str:
    """** over folders, * and ? inside one."""
    out = ""
    for part in re.split(r"(\*\*/?|\*|\?)", glob):
        out += {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(part, re.escape(part) if part else "")
    return f"^{out}$"


def code_pattern(text: str, regex: bool) -> str:
    """A text of several words becomes these words in order."""
    return text if regex else ".*".join(re.escape(w) for w in text.split()) if re.search(r"\s", text) else re.escape(text)


def line_matches(files: DataFrame, pattern: str, regex: bool = False, path: str = "path", text: str = "text") -> DataFrame:
    """(path, line, content) of lines that match, counted from 1.  The whole text is tested first, so that files without
    a match aren't cut into lines."""
    rx = code_pattern(pattern, regex)
    rows = files.filter(F.col(text).rlike(rx)) if not re.search(r"[$^]", rx) else files
    lines = rows.select(F.col(path).alias("path"), F.posexplode(F.split(text, "\n")).alias("p", "content"))
    return lines.filter(F.col("content").rlike(rx)).select("path", (F.col("p") + 1).cast("long").alias("line"), "content")


def tightest_span(lines: DataFrame, spans: DataFrame) -> DataFrame:
    """lines (path, line) with the id of the smallest span (id, file_path, start_line, end_line) around each, or null.

    A span is put into each block of BLOCK lines that it touches and a line into its own, so a line meets only spans near
    it, whatever the length of the file."""
    block = lambda c: F.floor(F.col(c) / BLOCK)
    s = spans.filter("start_line <= end_line").select(F.col("id").alias("span_id"), F.col("file_path").alias("__p"), "start_line", "end_line", F.explode(F.sequence(block("start_line"), block("end_line"))).alias("__b"))
    both = lines.withColumn("__l", block("line")).join(s, (F.col("path") == F.col("__p")) & (F.col("__l") == F.col("__b")) & F.col("line").between(F.col("start_line"), F.col("end_line")), "left")
    best = F.min(F.struct((F.col("end_line") - F.col("start_line")).alias("w"), "span_id"))
    return both.groupBy(*lines.columns).agg(best.alias("b")).select(*lines.columns, F.col("b.span_id").alias("span_id"))


def code_score(in_degree, label, path):
    vendored = F.lit(False)
    for word in ("vendor", "node_modules", "third_party"):
        vendored = vendored | F.contains(path, F.lit(word))
    return in_degree + F.when(label.isin("Function", "Method"), 10).when(label == "Route", 15).otherwise(0) - F.when(vendored, 50).otherwise(0) - F.when(F.contains(path, F.lit("test")), 5).otherwise(0)


def search_code(files: DataFrame, nodes: DataFrame, pattern: str, regex: bool = False, glob: str | None = None, path_regex: str | None = None, mode: str = "compact", context: int = 0, limit: int = CODE_LIMIT) -> dict:
    """Lines that match, by the symbol around them.  files: path, text; nodes: id, name, qualified_name, label, file_path,
    start_line, end_line, in_degree.

    Gives results (a frame of one row for each enclosing symbol, best first: id, qualified_name, label, file, score,
    matches, lines, of which the first MATCH_LINES; source in mode full, or context lines around the matches), raw (the
    first RAW matches outside any symbol), directories, and counts.  Mode files gives files alone.
    """
    if not pattern or not 1 <= limit <= CODE_LIMIT or mode not in ("compact", "full", "files"):
        raise ValueError("an empty pattern, a bad limit or an unknown mode")
    rows = files if glob is None else files.filter(F.col("path").rlike(glob_regex(glob)))
    rows = rows if path_regex is None else rows.filter(F.col("path").rlike(path_regex))
    hits = cut(tightest_span(line_matches(rows, pattern, regex), nodes.filter("start_line is not null")))
    inside, raw = hits.filter("span_id is not null"), hits.filter("span_id is null").drop("span_id").orderBy("path", "line")
    lines = F.slice(F.array_sort(F.collect_list("line")), 1, MATCH_LINES)
    per = inside.groupBy("span_id").agg(F.count("*").alias("matches"), lines.alias("lines"))
    scored = per.join(nodes, F.col("span_id") == F.col("id")).select("id", "qualified_name", "label", F.col("file_path").alias("file"), "start_line", "end_line", code_score(F.col("in_degree"), F.col("label"), F.col("file_path")).alias("score"), "matches", "lines")
    scored = cut(scored)
    found, best = scored.count(), scored.orderBy(F.desc("score"), "qualified_name", "id").limit(limit)
    if mode == "files":
        return {"files": best.select("file").unionByName(raw.select(F.col("path").alias("file"))).distinct().orderBy("file")}
    if mode == "full" or context:
        first, last = F.element_at("lines", 1), F.element_at("lines", -1)
        long = F.col("end_line") - F.col("start_line") + 1 > FULL_LINES
        lead = F.when(long & (first - FULL_LEAD > F.col("start_line")), first - FULL_LEAD).otherwise(F.col("start_line"))
        low = lead if mode == "full" else F.greatest(first - context, F.lit(1))
        high = F.when(long, F.least(lead + FULL_LINES - 1, F.col("end_line"))).otherwise(F.col("end_line")) if mode == "full" else last + context
        best = best.withColumn("shown_from", low).withColumn("__high", high).join(files.select(F.col("path").alias("file"), "text"), "file")
        shown = F.array_join(F.slice(F.split("text", "\n"), F.col("shown_from").cast("int"), (F.col("__high") - F.col("shown_from") + 1).cast("int")), "\n")
        best = best.withColumn("source" if mode == "full" else "context", shown).drop("text", "__high").orderBy(F.desc("score"), "qualified_name", "id")
    n, n_raw = hits.count(), raw.count()
    ratio = f"{n / (found + n_raw):.1f}x" if found and n else None
    warnings = ["the pattern has | but is no regex, so it is searched as it stands"] if "|" in pattern and not regex else []
    return {"results": best, "raw": raw.limit(RAW), "directories": directories(scored.select(F.col("file").alias("path"))), "lines": n, "found": found, "raw_found": n_raw, "ratio": ratio, "warnings": warnings}


def directories(lines: DataFrame) -> DataFrame:
    """(directory, n): matches by first path segment."""
    return lines.groupBy(F.concat(F.substring_index("path", "/", 1), F.lit("/")).alias("directory")).agg(F.count("*").alias("n"))


# Abbreviations and what they stand for.
ABBREVIATIONS = {
    "err": "error", "exc": "exception", "ex": "exception", "ctx": "context", "cfg": "config", "conf": "configuration", "env": "environment", "opt": "option", "opts": "options",
    "req": "request", "res": "response", "resp": "response", "rsp": "response", "hdr": "header", "hdrs": "headers", "str": "string", "fmt": "format", "msg": "message",
    "txt": "text", "lbl": "label", "desc": "description", "buf": "buffer", "arr": "array", "vec": "vector", "lst": "list", "dict": "dictionary", "tbl": "table", "stk": "stack",
    "que": "queue", "fn": "function", "func": "function", "cb": "callback", "proc": "procedure", "ctor": "constructor", "dtor": "destructor", "db": "database", "col": "column",
    "stmt": "statement", "txn": "transaction", "trx": "transaction", "repo": "repository", "auth": "authentication", "authz": "authorization", "perm": "permission",
    "cred": "credential", "tok": "token", "pwd": "password", "val": "value", "num": "number", "int": "integer", "bool": "boolean", "flt": "float", "dbl": "double", "idx": "index",
    "iter": "iterator", "elem": "element", "cnt": "count", "len": "length", "sz": "size", "pos": "position", "off": "offset", "cap": "capacity", "init": "initialize",
    "deinit": "deinitialize", "alloc": "allocate", "dealloc": "deallocate", "del": "delete", "rm": "remove", "impl": "implementation", "iface": "interface", "abs": "abstract",
    "decl": "declaration", "param": "parameter", "arg": "argument", "attr": "attribute", "prop": "property", "ret": "return", "src": "source", "dst": "destination",
    "tgt": "target", "orig": "original", "prev": "previous", "cur": "current", "tmp": "temporary", "temp": "temporary", "conn": "connection", "sess": "session", "sock": "socket",
    "addr": "address", "url": "uniform", "srv": "server", "cli": "client", "svc": "service", "ep": "endpoint", "mgr": "manager", "ctrl": "controller", "hdlr": "handler",
    "sched": "scheduler", "disp": "dispatcher", "reg": "registry", "chan": "channel", "sem": "semaphore", "mtx": "mutex", "wg": "waitgroup", "sig": "signal", "evt": "event",
    "sub": "subscriber", "pub": "publisher", "spec": "specification", "mock": "mock", "stub": "stub", "assert": "assertion", "log": "logging", "lvl": "level", "dbg": "debug",
    "wrn": "warning", "inf": "info", "ts": "timestamp", "dur": "duration", "ttl": "timetolive", "ver": "version", "ns": "namespace", "pkg": "package", "mod": "module",
    "lib": "library", "dep": "dependency", "ref": "reference", "ptr": "pointer", "obj": "object", "doc": "document", "cmd": "command", "ops": "operations", "util": "utility",
    "hlp": "helper", "ext": "extension",
}


def identifier_tokens(c, most: int | None = None):
    """Lower-case ASCII parts of an identifier, cut at marks and before capitals, at most `most`; what abbreviations stand
    for comes last."""
    parts = F.split(F.regexp_replace(c, "([a-z])([A-Z])", "$1 $2"), r"[./_\- (),:]+")
    plain = F.filter(F.transform(parts, lambda x: F.lower(F.regexp_replace(x, "[^A-Za-z0-9]", ""))), lambda x: x != "")
    table = F.create_map(*[F.lit(x) for kv in ABBREVIATIONS.items() for x in kv])
    out = F.concat(plain, F.filter(F.transform(plain, lambda x: F.try_element_at(table, x)), lambda x: x.isNotNull()))
    return out if most is None else F.slice(out, 1, most)


def term_counts(docs: DataFrame, key: str, tokens) -> DataFrame:
    """(key, n, term, tf): how often a row has each of its terms, and how many tokens it has.  A row is counted where it
    is read, so nothing is shuffled."""

    def run(batches):
        for batch in batches:
            column = batch.column(1)
            lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            coded = pc.list_flatten(column).dictionary_encode()
            size = max(len(coded.dictionary), 1)
            row = np.repeat(np.arange(len(lengths)), lengths)
            pairs, tf = np.unique(row * size + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
            at = pairs // size
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(lengths[at]), coded.dictionary.take(pa.array(pairs % size)), pa.array(tf.astype(np.int64))], names=[key, "n", "term", "tf"])

    return docs.select(key, tokens.alias("t")).mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, n long, term string, tf long")


def document_frequency(docs: DataFrame, key: str, tokens) -> DataFrame:
    """(token, df, idf_milli): idf = max(0, ln((N + 1) / (df + 1)) + 1), in thousandths."""
    held = docs.select(key, F.array_distinct(tokens).alias("t"))
    df = held.select(F.explode("t").alias("token")).groupBy("token").agg(F.count("*").alias("df"))
    n = held.agg(F.count("*").alias("n"))
    idf = F.greatest(F.lit(0.0), F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1)
    return df.crossJoin(F.broadcast(n)).select("token", "df", F.round(idf * 1000).cast("long").alias("idf_milli"))


def tfidf(docs: DataFrame, key: str, tokens) -> DataFrame:
    """(key, token, weight): term count times idf, rows scaled to length 1."""
    tf = term_counts(docs, key, tokens).select(key, F.col("term").alias("token"), "tf")
    both = tf.join(document_frequency(docs, key, tokens), "token").repartition(key)
    w = both.groupBy(key, "token", "idf_milli").agg(F.sum("tf").alias("tf")).withColumn("w", F.col("tf") * F.col("idf_milli") / 1000.0)
    # a key's terms meet once: rows that share it are added up there, its norm is taken and top_terms() ranks them
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key)))
    return w.withColumn("norm", norm).filter("norm > 0").select(key, "token", (F.col("w") / F.col("norm")).alias("weight"))


def top_terms(weights: DataFrame, key: str, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.round("weight", 6).desc(), "token"))
    return weights.withColumn("rank", rank).filter(F.col("rank") <= k)


def chunks(c, size: int):
    """A text cut into pieces of at most `size` characters: struct of start (from 0) and piece."""
    if not 256 <= size <= 8192:
        raise ValueError("chunks are from 256 to 8192")
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.length(c) - 1), F.lit(size))
    return F.transform(starts, lambda s: F.struct(s.alias("start"), F.substr(c, s + 1, F.lit(size)).alias("piece")))


def byte_chunks(rows: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """(key, start, stop, piece): texts cut into pieces of at most `size` bytes of UTF-8, never inside a character; start
    and stop are bytes.  An empty text has one empty piece, a null none."""
    if not CHUNK_BYTES[0] <= size <= CHUNK_BYTES[1]:
        raise ValueError(f"chunks are from {CHUNK_BYTES[0]} to {CHUNK_BYTES[1]} bytes")

    def run(batches):
        for batch in batches:
            for k, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if value is None:
                    continue
                raw, at, out = value.encode("utf-8"), 0, []
                while at < len(raw) or not out:
                    stop = min(at + size, len(raw))
                    while stop < len(raw) and raw[stop] & 0xC0 == 0x80:
                        stop -= 1
                    out.append((at, stop, raw[at:stop].decode("utf-8")))
                    at = stop
                starts, stops, pieces = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array([k] * len(out), batch.column(0).type), pa.array(starts, pa.int64()), pa.array(stops, pa.int64()), pa.array(pieces, pa.string())], names=[key, "start", "stop", "piece"])

    return rows.select(key, text).mapInArrow(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, start long, stop long, piece string")


CHUNK_BYTES = (256, 8192)


def snippet(node: DataFrame, files: DataFrame) -> DataFrame:
    """(id, path, start_line, end_line, source, fresh) of nodes (id, file_path, start_line, end_line) in files (path, text,
    content_hash): their lines as they stand, and whether the text is still the one of its hash."""
    both = node.join(files, F.col("file_path") == F.col("path"))
    source = F.array_join(F.slice(F.split("text", "\n"), F.col("start_line").cast("int"), (F.col("end_line") - F.col("start_line") + 1).cast("int")), "\n")
    return both.select("id", "path", "start_line", "end_line", source.alias("source"), (F.sha2(F.encode("text", "UTF-8"), 256) == F.col("content_hash")).alias("fresh"))
