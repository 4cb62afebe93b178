"""Filtered and ranked node search, symbol resolution and full-text ranking."""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plexloom.graph import GraphView
from plexloom.operators.text import term_counts
from plexloom.operators.traverse import cut

PAGE = 200
K1, B = 1.2, 0.75
SUGGESTIONS = 10
# Search order of labels of a name that is asked for: types, callables, fields, containers, then others.
LABEL_TIERS = [
    ["Class", "Struct", "Interface", "Enum", "Record", "Trait", "TypeAlias", "Annotation"],
    ["Function", "Method", "Constructor"],
    ["Field", "Property", "Constant"],
    ["Module", "Namespace", "Package", "File"],
]
CALLABLE = ["Function", "Method"]
SEARCHED = ["name", "qualified_name", "label", "file_path"]


class SymbolNotFound(LookupError):
    """No symbol of this name; suggestions are (id, qualified_name) of some that hold it."""

    def __init__(self, text: str, suggestions: list[tuple[str, str]]) -> None:
        super().__init__(f"no symbol {text!r}; like it: {', '.join(q for _, q in suggestions) or 'none'}")
        self.suggestions = suggestions


class AmbiguousSymbol(LookupError):
    """Several symbols of this name; candidates are (id, qualified_name), in order."""

    def __init__(self, text: str, candidates: list[tuple[str, str]]) -> None:
        super().__init__(f"{text!r} may be any of {', '.join(q for _, q in candidates)}")
        self.candidates = candidates


@dataclass
class SearchRequest:
    query: str | None = None
    name_pattern: str | None = None
    qualified_pattern: str | None = None
    file_pattern: str | None = None
    label: str | None = None
    relationship: str | None = None
    min_degree: int | None = None
    max_degree: int | None = None
    exclude_entry_points: bool = False
    include_connected: bool = False
    limit: int = PAGE
    offset: int = 0
    cursor: str | None = None
    degrees: bool = False

    def fingerprint(self) -> str:
        own = {k: v for k, v in asdict(self).items() if k not in ("limit", "offset", "cursor")}
        return hashlib.sha256(json.dumps(own, sort_keys=True).encode()).hexdigest()[:16]

    def start(self) -> int:
        """Where the page starts; a cursor of another request is an error, as is one beside an offset."""
        if self.cursor is None:
            return self.offset
        m = re.fullmatch(r"page1:([0-9a-f]{16}):(\d+)", self.cursor)
        if not m or m[1] != self.fingerprint() or self.offset:
            raise ValueError("the cursor doesn't belong to this request")
        return int(m[2])

    def next_cursor(self, total: int) -> str | None:
        end = self.start() + self.limit
        return f"page1:{self.fingerprint()}:{end}" if end < total else None


def literal_of(pattern: str) -> str | None:
    """The text that an anchored pattern without operators stands for, so that equality can be pushed down."""
    m = re.fullmatch(r"\^([\w \-]+)\$", pattern)
    return m[1] if m else None


def _matches(column: str, pattern: str):
    plain = literal_of(pattern)
    return F.col(column) == plain if plain is not None else F.coalesce(F.col(column).rlike(pattern), F.lit(False))


def connected_names(view: GraphView, kind: str = "CALLS") -> DataFrame:
    """(id, connected): sorted distinct names of the neighbours over one kind, either way."""
    own = view.edges.filter(F.col("kind") == kind)
    pairs = own.select(F.col("source").alias("id"), F.col("target").alias("other")).unionByName(own.select(F.col("target").alias("id"), F.col("source").alias("other"))).distinct()
    names = view.nodes.select(F.col("id").alias("other"), F.col("name").alias("other_name"))
    return pairs.join(names, "other").groupBy("id").agg(F.array_sort(F.collect_set("other_name")).alias("connected"))


def search_filter(view: GraphView, r: SearchRequest) -> DataFrame:
    """All nodes that fit, unordered; with rank if a text is searched for, and with degrees if they are asked for or
    filtered by.  Degrees are counted for the nodes alone that fit otherwise."""
    df = view.nodes
    for column, pattern in (("name", r.name_pattern), ("qualified_name", r.qualified_pattern), ("file_path", r.file_pattern)):
        if pattern is not None:
            df = df.filter(_matches(column, pattern))
    if r.label is not None:
        df = df.filter(F.col("label") == r.label)
    if r.exclude_entry_points:
        df = df.filter(~F.coalesce(F.get_json_object("properties", "$.is_entry_point") == "true", F.lit(False)))
    if r.relationship is not None:
        ends = view.edges.filter(F.col("kind") == r.relationship).select(F.explode(F.array("source", "target")).alias("id")).distinct()
        df = df.join(ends, "id", "left_semi")
    if r.query is not None:
        hits = text_search(view.nodes.select("id", F.concat_ws(" ", *SEARCHED).alias("text")), "id", "text", r.query, folded=True)
        df = df.join(hits.withColumnRenamed("score", "rank"), "id")
    if r.degrees or r.min_degree is not None or r.max_degree is not None:
        ends = view.edges.select(F.explode(F.array(F.struct(F.col("source").alias("id"), F.lit(0).alias("i")), F.struct(F.col("target").alias("id"), F.lit(1).alias("i")))).alias("x")).select("x.id", "x.i")
        d = ends.join(df.select("id"), "id", "left_semi").groupBy("id").agg(F.sum("i").alias("in_degree"), F.sum(1 - F.col("i")).alias("out_degree"))
        df = df.join(d, "id", "left")
        for c in ("in_degree", "out_degree"):
            df = df.withColumn(c, F.coalesce(c, F.lit(0).cast("long")))
        df = df.withColumn("degree", F.col("in_degree") + F.col("out_degree"))
    if r.min_degree is not None:
        df = df.filter(F.col("degree") >= r.min_degree)
    if r.max_degree is not None:
        df = df.filter(F.col("degree") <= r.max_degree)
    if r.include_connected:
        df = df.join(connected_names(view, r.relationship or "CALLS"), "id", "left").withColumn("connected", F.coalesce("connected", F.expr("cast(array() as array<string>)")))
    return df


def ranked(df: DataFrame, r: SearchRequest) -> DataFrame:
    """Nodes in order: for a single word, those of that name and then of that name in other letters, types first; then by
    rank of the text search, qualified name and id."""
    plain = (r.query or "").strip()
    plain = plain if re.fullmatch(r"\w+", plain) else (m[1] if (m := re.fullmatch(r"\^?(\w+)\$?", r.name_pattern or "")) else "")
    keys = []
    if plain:
        tier = F.lit(len(LABEL_TIERS))
        for k, labels in reversed(list(enumerate(LABEL_TIERS))):
            tier = F.when(F.col("label").isin(labels), k).otherwise(tier)
        fits = F.when(F.col("name") == plain, 0).when(F.lower("name") == plain.lower(), 1).otherwise(2)
        keys = [fits, F.when(fits < 2, tier).otherwise(99)]
    return df.orderBy(*keys, *(["rank"] if "rank" in df.columns else []), "qualified_name", "id")


def search_graph(view: GraphView, r: SearchRequest) -> tuple[DataFrame, int, str | None]:
    """The page, the number of all, and the cursor of the next page."""
    if not 1 <= r.limit <= PAGE:
        raise ValueError(f"limit must be from 1 to {PAGE}")
    found = cut(search_filter(view, r))
    total = found.count()
    return ranked(found, r).offset(r.start()).limit(r.limit), total, r.next_cursor(total)


def resolve_symbol(view: GraphView, text: str, callables: bool = False) -> DataFrame:
    """Nodes that a name may mean, in order: of an exact qualified name, else those that end in it after a separator, if
    it has one itself, else those of that name."""
    nodes = view.nodes.filter(F.col("label").isin(CALLABLE)) if callables else view.nodes
    exact = F.col("qualified_name") == text
    if re.search(r"\.|::|/", text):
        before = F.left("qualified_name", F.length("qualified_name") - len(text))
        loose = F.endswith("qualified_name", F.lit(text)) & (F.endswith(before, F.lit(".")) | F.endswith(before, F.lit("::")) | F.endswith(before, F.lit("/")))
    else:
        loose = F.col("name") == text
    rows = nodes.filter(exact | loose).withColumn("tier", F.when(exact, 0).otherwise(1))
    best = rows.agg(F.min("tier").alias("best"))
    return rows.join(F.broadcast(best), F.col("tier") == F.col("best")).drop("tier", "best").orderBy("qualified_name", "id")


def resolve_one(view: GraphView, text: str, callables: bool = False) -> DataFrame:
    """The one node that a name means, as a frame of one row; AmbiguousSymbol or SymbolNotFound if there isn't one."""
    found = [(r["id"], r["qualified_name"]) for r in resolve_symbol(view, text, callables).select("id", "qualified_name").limit(PAGE).collect()]
    exact = [f for f in found if f[1] == text]
    found = exact[:1] or found
    if not found:
        nodes = view.nodes.filter(F.col("label").isin(CALLABLE)) if callables else view.nodes
        holds = F.contains(F.lower("name"), F.lit(text.lower())) | F.contains(F.lower("qualified_name"), F.lit(text.lower()))
        raise SymbolNotFound(text, [tuple(r) for r in nodes.filter(holds).select("id", "qualified_name").orderBy("qualified_name", "id").limit(SUGGESTIONS).collect()])
    if len(found) > 1:
        raise AmbiguousSymbol(text, found)
    return view.nodes.filter(F.col("id") == found[0][0])


TOKENS = r"[^\p{L}\p{N}_]+"


def tokens(c):
    return F.filter(F.split(F.lower(c), TOKENS), lambda x: x != "")


def _folded(text: str) -> str:
    """Small letters without accents."""
    return "".join(c for c in unicodedata.normalize("NFD", text.lower()) if unicodedata.category(c) != "Mn")


#: Letters with accents up to U+1EFF, and the letter that each is without them.
_ACCENTED = {c: f for c in map(chr, range(0xC0, 0x1F00)) if len(f := _folded(c)) == 1 and f != c.lower() and c.isalpha()}


def folded_tokens(c):
    """Words of letters and digits, in small letters and without accents, as names are searched."""
    plain = F.translate(F.lower(c), "".join(_ACCENTED), "".join(_ACCENTED.values()))
    return F.filter(F.split(F.regexp_replace(plain, r"\p{Mn}+", ""), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def equals(word: str):
    return lambda x: x == word


def bm25(docs: DataFrame, key: str, text: str, terms: list[str]) -> DataFrame:
    """(key, score) of the rows that hold every term, by Okapi's formula negated: lower is better."""
    return text_search(docs, key, text, " ".join(sorted({t.lower() for t in terms})))


def parse_text_query(query: str) -> list[list[tuple[str, bool, bool]]]:
    """Alternatives (OR), each of terms (word, is a prefix, is excluded) that must all hold: words, prefixes with *, words
    after NOT, and the words in quotes; AND may be written."""
    out: list[list[tuple[str, bool, bool]]] = [[]]
    without = False
    for m in re.finditer(r'"([^"]*)"|(\w+)(\*?)', query):
        if m[2] in ("OR", "AND", "NOT"):
            if m[2] == "OR":
                out.append([])
            without = m[2] == "NOT"
            continue
        out[-1] += [(w.lower(), m[3] == "*", without) for w in ([m[2]] if m[2] else re.findall(r"\w+", m[1]))]
        without = False
    return [a for a in out if any(not excluded for *_, excluded in a)]


def _hit(words, term: tuple[str, bool, bool]):
    return F.filter(words, (lambda x: F.startswith(x, F.lit(term[0]))) if term[1] else equals(term[0]))


def _score(counts: DataFrame, total: DataFrame, key: str, query: list[list[tuple[str, bool, bool]]], names: dict) -> DataFrame:
    """Rows of counts (key, n, tf0, ...) that the query fits, scored; total is one row."""
    both = counts.crossJoin(F.broadcast(total))
    score, used = F.lit(0.0), {t[:2] for a in query for t in a if not t[2]}
    for t in used:
        tf, df = F.col(f"tf{names[t]}"), F.col(f"df{names[t]}")
        idf = F.log(1 + (F.col("docs") - df + 0.5) / (df + 0.5))
        score = score + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("n") / F.col("avg")))
    fits = F.lit(False)
    for a in query:
        one = F.lit(True)
        for t in a:
            one = one & ((F.col(f"tf{names[t[:2]]}") > 0) != F.lit(t[2]))
        fits = fits | one
    return both.filter(fits).select(key, (-score).alias("score"))


def text_search(docs: DataFrame, key: str, text: str, query: str, folded: bool = False) -> DataFrame:
    """(key, score) of the rows that a text query fits; each text is read once, and only its counts are kept.  If folded,
    words have no accents and end at underscores, in texts as in the query."""
    parsed = parse_text_query(query)
    if folded:
        parsed = [[(w, prefix, excluded) for word, prefix, excluded in a for w in re.findall(r"[^\W_]+", _folded(word))] for a in parsed]
    terms = sorted({t[:2] for a in parsed for t in a})
    names = {t: i for i, t in enumerate(terms)}
    held = docs.select(key, (folded_tokens if folded else tokens)(F.col(text)).alias("t")).withColumn("n", F.size("t"))
    counts = cut(held.select(key, "n", *[F.size(_hit("t", (*t, False))).alias(f"tf{i}") for i, t in enumerate(terms)]))
    total = counts.agg(F.count("*").alias("docs"), F.avg("n").alias("avg"), *[F.sum((F.col(f"tf{i}") > 0).cast("long")).alias(f"df{i}") for i in range(len(terms))])
    return _score(counts, total, key, parsed, names)


def build_text_index(docs: DataFrame, key: str, text: str, path: str) -> None:
    """Write an inverted index: postings (term, key, tf, n) in order of their terms, so that a query reads the files of
    its own terms only, and the number and mean length of texts.  The index is made once and read by every query."""
    held = docs.select(key, tokens(F.col(text)).alias("t")).withColumn("n", F.size("t"))
    postings = term_counts(docs, key, tokens(F.col(text))).select("term", key, "n", "tf")  # shuffled once, into their order
    postings.repartitionByRange("term", key).sortWithinPartitions("term", key).write.mode("overwrite").parquet(f"{path}/postings")
    held.agg(F.count("*").alias("docs"), F.avg("n").alias("avg")).write.mode("overwrite").parquet(f"{path}/totals")


def search_text_index(spark: SparkSession, path: str, key: str, query: str) -> DataFrame:
    """(key, score) as text_search gives them, from the postings of the query's terms."""
    parsed = parse_text_query(query)
    terms = sorted({t[:2] for a in parsed for t in a})
    names = {t: i for i, t in enumerate(terms)}
    exact, prefixes = [t for t, p in terms if not p], [t for t, p in terms if p]
    wanted = F.col("term").isin(*exact) if exact else F.lit(False)
    for p in prefixes:
        wanted = wanted | F.startswith("term", F.lit(p))
    postings = spark.read.parquet(f"{path}/postings").filter(wanted)
    of = lambda t: F.startswith("term", F.lit(t[0])) if t[1] else F.col("term") == t[0]
    counts = postings.groupBy(key).agg(F.first("n").alias("n"), *[F.coalesce(F.sum(F.when(of(t), F.col("tf"))), F.lit(0)).alias(f"tf{i}") for i, t in enumerate(terms)])
    df = counts.agg(*[F.coalesce(F.sum((F.col(f"tf{i}") > 0).cast("long")), F.lit(0)).alias(f"df{i}") for i in range(len(terms))])
    return _score(counts, spark.read.parquet(f"{path}/totals").crossJoin(F.broadcast(df)), key, parsed, names)
