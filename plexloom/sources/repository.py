"""Source files and version history as DataFrames."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plexloom.operators.names import trackable

MOST_BYTES = 512 << 20
# Folders, names and suffixes that are never read, and those that a fast scan leaves out besides.
CORE_FOLDERS = ".git node_modules .worktrees .claude-worktrees".split()
SKIPPED_FOLDERS = """.git .hg .svn .worktrees .idea .vs .vscode .eclipse .claude .claude-worktrees Antigravity .cache .eggs .env .mypy_cache .nox .pytest_cache .ruff_cache .tox .venv __pycache__ env
htmlcov site-packages venv .npm .nyc_output .pnpm-store .yarn bower_components coverage node_modules .next .nuxt .svelte-kit .angular .turbo .parcel-cache .docusaurus .expo dist obj Pods target
temp tmp .terraform .serverless bazel-bin bazel-out bazel-testlogs .cargo .stack-work .dart_tool zig-cache zig-out .metals .bloop .bsp .ccls-cache .clangd elm-stuff _opam .cpcache .shadow-cljs
.vercel .netlify deploy deployed .qdrant_code_embeddings .tmp vendor vendored""".split()
FAST_FOLDERS = """generated gen auto-generated fixtures testdata test_data __tests__ __mocks__ __snapshots__ __fixtures__ __test__ docs doc documentation examples example samples sample assets static
public media third_party thirdparty 3rdparty external migrations seeds e2e integration locale locales i18n l10n scripts tools hack bin build out""".split()
SKIPPED_SUFFIXES = ".tmp ~ .pyc .pyo .o .a .so .dll .class .png .jpg .jpeg .gif .ico .bmp .tiff .webp .svg .wasm .node .exe .bin .dat .db .sqlite .sqlite3 .woff .woff2 .ttf .eot .otf".split()
FAST_SUFFIXES = """.zip .tar .gz .bz2 .xz .rar .7z .jar .war .ear .mp3 .mp4 .avi .mov .wav .flac .ogg .mkv .webm .pdf .doc .docx .xls .xlsx .ppt .pptx .odt .ods .map .min.js .min.css .pem .crt
.key .cer .p12 .pb .avro .parquet .beam .elc .rlib .coverage .prof .out .patch .diff""".split()
SKIPPED_NAMES = """package.json package-lock.json tsconfig.json jsconfig.json composer.json composer.lock yarn.lock openapi.json swagger.json jest.config.json .eslintrc.json .prettierrc.json
.babelrc.json tslint.json angular.json firebase.json renovate.json lerna.json turbo.json .stylelintrc.json pnpm-lock.json deno.json biome.json devcontainer.json .devcontainer.json launch.json
settings.json extensions.json tasks.json""".split()
FAST_NAMES = """LICENSE LICENSE.txt LICENSE.md LICENSE-MIT LICENSE-APACHE LICENCE LICENCE.txt LICENCE.md CHANGELOG CHANGELOG.md CHANGES.md HISTORY HISTORY.md AUTHORS AUTHORS.md CONTRIBUTORS
CONTRIBUTORS.md CODEOWNERS go.sum yarn.lock pnpm-lock.yaml Pipfile.lock poetry.lock Gemfile.lock Cargo.lock mix.lock flake.lock pubspec.lock composer.lock package-lock.json configure Makefile.in
config.guess config.sub""".split()
FAST_PARTS = ".d.ts .bundle. .chunk. .generated. .pb.go _pb2.py .pb2.py _grpc.pb.go _string.go mock_ _mock. _test_helpers. .stories. .spec. .test.".split()
# Languages by whole name, compound suffix and suffix.
BY_NAME = {"Dockerfile": "dockerfile", "Makefile": "make", "CMakeLists.txt": "cmake", "go.mod": "gomod"}
BY_COMPOUND = {".d.ts": "typescript", ".blade.php": "blade"}
BY_SUFFIX = {
    "py": "python", "rs": "rust", "go": "go", "java": "java", "kt": "kotlin", "scala": "scala", "js": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "tsx", "c": "c", "h": "c",
    "cpp": "cpp", "hpp": "cpp", "cs": "csharp", "rb": "ruby", "php": "php", "swift": "swift", "sql": "sql", "sh": "bash", "toml": "toml", "yaml": "yaml", "yml": "yaml", "json": "json", "md": "markdown",
}


def discover(spark: SparkSession, root: str, most_bytes: int = MOST_BYTES, fast: bool = False, overrides: dict[str, str] | None = None) -> DataFrame:
    """(path, length, modified, content_hash, text, language) of the text files under root."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    rel = F.regexp_replace("path", r"^[a-z]+:/*", "/")
    files = files.filter(F.col("length") <= most_bytes).withColumn("path", F.substr(rel, F.lit(len("/" + root.strip("/")) + 2)))
    return files.filter(allowed(F.col("path"), fast)).select("path", "length", F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("content_hash"), F.decode("content", "UTF-8").alias("text"), language(F.col("path"), overrides).alias("language"))


def allowed(path, fast: bool = False):
    """Whether a file is read: none of its folders, and neither its name nor its suffix, is one that is left out."""
    parts = F.split(path, "/")
    folders, name = F.slice(parts, 1, F.size(parts) - 1), F.element_at(parts, -1)
    out = ~F.arrays_overlap(folders, F.array(*[F.lit(x) for x in SKIPPED_FOLDERS + FAST_FOLDERS * fast])) & ~name.isin(SKIPPED_NAMES + FAST_NAMES * fast)
    for s in SKIPPED_SUFFIXES + FAST_SUFFIXES * fast:
        out = out & ~F.endswith(name, F.lit(s))
    for s in FAST_PARTS * fast:
        out = out & ~F.contains(name, F.lit(s))
    return out


def language(path, overrides: dict[str, str] | None = None):
    """By a given suffix of `overrides`, then whole name, compound suffix and suffix; null if none is known."""
    name = F.substring_index(path, "/", -1)
    table = lambda m: F.create_map(*[F.lit(x) for kv in m.items() for x in kv])
    compound = F.lit(None).cast("string")
    for s in sorted(BY_COMPOUND, key=len):
        compound = F.when(F.endswith(name, F.lit(s)), BY_COMPOUND[s]).otherwise(compound)
    given = F.lit(None).cast("string")
    for s in sorted(overrides or {}, key=len):
        given = F.when(F.endswith(name, F.lit(s)), overrides[s]).otherwise(given)
    return F.coalesce(given, F.try_element_at(table(BY_NAME), name), compound, F.when(F.contains(name, F.lit(".")), F.try_element_at(table(BY_SUFFIX), F.lower(F.substring_index(name, ".", -1)))))


def ignore_filter(path, rules: list[str]):
    """True where the last ignore rule that fits a path doesn't exclude it; a rule with ! includes again."""
    from plexloom.operators.text import glob_regex

    out = F.lit(True)
    for rule in rules:
        if not rule.strip() or rule.startswith("#"):
            continue
        keep, glob = rule.startswith("!"), rule.removeprefix("!").rstrip("/")
        body = glob_regex(glob.removeprefix("/"))[1:-1]
        rx = f"^{body}(/|$)" if "/" in glob else f"(^|/){body}(/|$)"
        out = F.when(path.rlike(rx), F.lit(keep)).otherwise(out)
    return out


def stacked_ignore(path, rule_sets: list[tuple[str, list[str]]]):
    """ignore_filter() with rules of several folders: those of a folder (its path, empty for the root) count for what lies
    in it, and those of a deeper one come after.  Folders that are never read stay out, whatever a rule says."""
    from plexloom.operators.text import glob_regex

    out = F.lit(True)
    for base, rules in sorted(rule_sets, key=lambda r: (r[0].count("/") + bool(r[0]), r[0])):
        prefix = base.strip("/") + "/" if base.strip("/") else ""
        rel = F.substr(path, F.lit(len(prefix) + 1))
        for rule in rules:
            if not rule.strip() or rule.startswith("#"):
                continue
            keep, glob = rule.startswith("!"), rule.removeprefix("!").rstrip("/")
            body = glob_regex(glob.removeprefix("/"))[1:-1]
            rx = f"^{body}(/|$)" if "/" in glob else f"(^|/){body}(/|$)"
            out = F.when(F.startswith(path, F.lit(prefix)) & rel.rlike(rx), F.lit(keep)).otherwise(out)
    return out & ~F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(x) for x in CORE_FOLDERS]))


def manifests(files: DataFrame) -> DataFrame:
    """(manifest, name, root, entry) of the package manifests among files (path, text): package.json, go.mod, Cargo.toml
    and pyproject.toml; those that name no package are left out."""
    path, text_ = F.col("path"), F.col("text")
    base = F.element_at(F.split(path, "/"), -1)
    of_json = lambda k: F.try_variant_get(F.try_parse_json("text"), f"$.{k}", "string")
    section = F.regexp_extract(text_, r"(?sm)^[ \t]*\[(?:package|project|tool\.poetry)\][ \t]*\r?$(.*?)(?=^[ \t]*\[|\z)", 1)
    toml = F.regexp_extract(section, r"""(?m)^[ \t]*name[ \t]*=[ \t]*["']?([^"'\r\n]*?)["']?[ \t]*\r?$""", 1)
    go = F.trim(F.regexp_extract(text_, r"(?m)^[ \t]*module ([^\r\n]*)", 1))
    name = F.when(F.endswith(path, F.lit("package.json")), of_json("name")).when(F.endswith(path, F.lit("go.mod")), F.nullif(go, F.lit(""))).when(base.isin("Cargo.toml", "pyproject.toml"), F.nullif(toml, F.lit("")))
    entry = F.when(F.endswith(path, F.lit("package.json")), F.coalesce(of_json("module"), of_json("main")))
    root = F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "/[^/]*$", "")).otherwise("")
    return files.select(path.alias("manifest"), name.alias("name"), root.alias("root"), entry.alias("entry")).filter("name is not null")


#: Line numbers of a block of a log, and the tasks that blocks are dealt to at least.
BLOCK_LINES, BLOCK_TASKS = 1 << 18, 200


def tasks(spark: SparkSession) -> int:
    """Tasks that lines are dealt to: as the number is given, adaptive execution doesn't gather them into a few large ones."""
    return max(BLOCK_TASKS, int(spark.conf.get("spark.sql.shuffle.partitions")))


def git_log(lines: DataFrame) -> DataFrame:
    """(sha, ts, path) of a log (n, value) whose COMMIT:<sha>:<ts> lines head the paths of each commit; several logs have a
    column `repo`.

    A log is cut into blocks of BLOCK_LINES line numbers, so no task holds a whole one.  Lines before a block's first
    header have the last header of the blocks before it, for which one row a block is enough.
    """
    head = F.when(F.startswith("value", F.lit("COMMIT:")), F.regexp_extract("value", r"^COMMIT:([0-9a-f]+):(\d+)$", 0)).otherwise("")
    n = F.coalesce(F.col("n").cast("long"), F.lit(-(1 << 63)))
    log = ["repo", "none"] if "repo" in lines.columns else []
    named = [F.coalesce("repo", F.lit("")).alias("repo"), F.col("repo").isNull().alias("none")] if log else []
    at = ["block", *log]
    dealt = lines.select(*named, F.shiftright(n, BLOCK_LINES.bit_length() - 1).alias("block"), n.alias("n"), "value").repartition(tasks(lines.sparkSession), *at)
    last = dealt.groupBy(*at).agg(F.max_by("value", F.when(head != "", F.col("n"))).alias("last"))
    before = Window.partitionBy(*log).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select(*at, F.last("last", True).over(before).alias("carried"))
    by = Window.partitionBy(*at).orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    known = dealt.withColumn("h", F.last(F.when(head != "", head), True).over(by)).filter((head == "") & (F.col("value") != ""))
    h = F.split(F.coalesce("h", "carried"), ":")
    return known.join(carried, at, "left").filter(F.coalesce("h", "carried").isNotNull()).select(F.element_at(h, 2).alias("sha"), F.element_at(h, 3).cast("long").alias("ts"), F.col("value").alias("path"))


def diff_hunks(lines: DataFrame) -> DataFrame:
    """(path, first, last) of the new side of a unified diff (n, value)."""
    path = F.regexp_extract("value", r"^\+\+\+ b/(.*)$", 1)
    at = Window.orderBy("n").rowsBetween(Window.unboundedPreceding, 0)  # a diff is one small text
    rows = lines.withColumn("path", F.last(F.when(path != "", path), True).over(at)).withColumn("h", F.expr(r"regexp_extract_all(value, '^@@ -[0-9,]+ \\+([0-9]+)(,[0-9]+)? @@', 1)")).filter(F.size("h") > 0)
    size = F.regexp_extract("value", r"^@@ -[0-9,]+ \+[0-9]+,([0-9]+) @@", 1)
    first, n = F.col("h")[0].cast("long"), F.when(size == "", 1).otherwise(size.try_cast("long"))
    return rows.filter(trackable(F.col("path")) & (first > 0)).select("path", first.alias("first"), (first + F.greatest(n, F.lit(1)) - 1).alias("last"))


def name_status(lines: DataFrame, most: int = 10_000) -> DataFrame:
    """(status, path, old_path) of the lines (n, value) of a name-status listing, in order; a rename has its old path.
    Files that history doesn't count are left out; at most `most`, as `git` itself is asked for no more."""
    f = F.split(F.regexp_replace("value", r"\r$", ""), "\t")
    status = F.substr(f[0], F.lit(1), F.lit(1))
    renamed = status == "R"
    path = F.when(renamed, F.coalesce(F.get(f, F.lit(2)), F.get(f, F.lit(1)))).otherwise(F.get(f, F.lit(1)))
    rows = lines.select("n", status.alias("status"), path.alias("path"), F.when(renamed, F.get(f, F.lit(1))).alias("old_path"))
    return rows.filter((F.col("status") != "") & F.col("path").isNotNull() & trackable(F.col("path"))).orderBy("n").limit(most).drop("n")


def changed_files(*sources: DataFrame) -> DataFrame:
    """(path) of the sorted set of what several listings name: a diff with the base, the worktree's, and its status.  A
    listing is (path), or (value) with NUL between paths, of a porcelain status after two letters and a blank."""
    out = None
    for s in sources:
        if "path" not in s.columns:
            s = s.select(F.explode(F.split("value", "\0")).alias("path"))
            s = s.select(F.regexp_replace("path", r"^[ MADRCUT?!]{2} ", "").alias("path"))
        s = s.select("path").filter(F.col("path") != "")
        out = s if out is None else out.unionByName(s)
    return out.filter(trackable(F.col("path"))).distinct().orderBy("path")


def git_context(root: str) -> dict:
    """Whether root is in a repository, and its root, branch and head, read from the files of .git on the driver."""
    at = Path(root).resolve()
    while not (at / ".git").exists():
        if at == at.parent:
            return {"is_git": False, "root": str(Path(root).resolve()), "branch": None, "head": None, "worktree": False}
        at = at.parent
    git = at / ".git"
    worktree = git.is_file()  # a linked worktree has a file that names its folder
    if worktree:
        git = (at / git.read_text().removeprefix("gitdir:").strip()).resolve()
    head = (git / "HEAD").read_text().strip()
    branch = head.removeprefix("ref: refs/heads/") if head.startswith("ref: refs/heads/") else None
    if branch is not None:
        common = (git / (git / "commondir").read_text().strip()).resolve() if (git / "commondir").exists() else git
        loose, packed = common / "refs/heads" / branch, common / "packed-refs"
        lines = packed.read_text().splitlines() if packed.exists() else []
        head = loose.read_text().strip() if loose.exists() else next((x.split()[0] for x in lines if x.endswith(f" refs/heads/{branch}")), None)
    return {"is_git": True, "root": str(at), "branch": branch, "head": head, "worktree": worktree}
