"""Selections of several sources, line ranges, mentions in text, and noise."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import text as T


def allocate(strands: DataFrame, budget: int) -> DataFrame:
    """(name, share) -> with budget: shares over 1 in sum are scaled down; rounded half away from zero."""
    total = F.sum("share").over(Window.partitionBy())  # a few strands
    return strands.withColumn("budget", F.round(F.col("share") / F.greatest(total, F.lit(1.0)) * budget).cast("long"))


def merge_strands(picks: DataFrame) -> DataFrame:
    """(strand, policy, ord, path, first, last) -> those that survive, in strand order.

    A null range is the whole file. Within a strand the first of equal picks stays. A later pick that overlaps an earlier
    one of the same path removes it under prefer-newer, or goes itself under exclude-overlap; merge keeps both. The
    overlap join is by path with the ranges as a residual.
    """
    one = picks.groupBy("strand", "policy", "path", "first", "last").agg(F.min("ord").alias("ord"))
    lo, hi = F.coalesce("first", F.lit(0)), F.coalesce("last", F.lit(2**31 - 1))
    a = one.withColumns({"lo": lo, "hi": hi})
    earlier = a.select(F.col("strand").alias("e_strand"), F.col("ord").alias("e_ord"), F.col("path").alias("e_path"), F.col("lo").alias("e_lo"), F.col("hi").alias("e_hi"))
    later = a.select(F.col("strand").alias("l_strand"), F.col("ord").alias("l_ord"), F.col("policy").alias("l_policy"), F.col("path").alias("l_path"), F.col("lo").alias("l_lo"), F.col("hi").alias("l_hi"))
    before = (F.col("strand") < F.col("l_strand")) | ((F.col("strand") == F.col("l_strand")) & (F.col("ord") < F.col("l_ord")))
    after = (F.col("e_strand") < F.col("strand")) | ((F.col("e_strand") == F.col("strand")) & (F.col("e_ord") < F.col("ord")))
    newer = (F.col("path") == F.col("l_path")) & before & (F.col("l_policy") == "prefer-newer") & (F.col("l_lo") <= F.col("hi")) & (F.col("lo") <= F.col("l_hi"))
    kept = a.join(later, newer, "left_anti")
    older = (F.col("path") == F.col("e_path")) & after & (F.col("policy") == "exclude-overlap") & (F.col("e_lo") <= F.col("hi")) & (F.col("lo") <= F.col("e_hi"))
    return kept.join(earlier, older, "left_anti").select("strand", "policy", "ord", "path", "first", "last")


def merge_ranges(ranges: DataFrame, gap: int = 1) -> DataFrame:
    """(path, first, last) -> merged: ranges that overlap or touch become one."""
    w = Window.partitionBy("path").orderBy("first", "last")
    before = F.max("last").over(w.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(before.isNull() | (F.col("first") > before + gap), 1).otherwise(0)
    runs = ranges.withColumn("opens", opens).withColumn("run", F.sum("opens").over(w))
    return runs.groupBy("path", "run").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("run")


def widen(ranges: DataFrame, around: int) -> DataFrame:
    return ranges.select("path", F.greatest(F.col("first") - around, F.lit(1)).alias("first"), (F.col("last") + around).alias("last"))


def excerpt(lines: DataFrame, ranges: DataFrame) -> DataFrame:
    """Lines inside any of the ranges, with each range merged before, so a line comes once. Joined by path, ranges as a residual."""
    merged = merge_ranges(ranges)
    return lines.join(merged, "path").where(F.col("line_no").between(F.col("first"), F.col("last"))).select("path", "line_no", "text")


def mentions(texts: DataFrame) -> DataFrame:
    """(id, text) -> (id, mention, first, last): words that look like paths, with the lines they name."""
    words = F.regexp_extract_all("text", F.lit(r"((?:\./)?[A-Za-z0-9_][A-Za-z0-9_./-]*\.[A-Za-z][A-Za-z0-9]*(?:(?::|#L)\d{1,9}(?:-L?\d{1,9})?)?)"), F.lit(1))
    spec = T.line_spec(F.col("word"))
    each = texts.select("id", F.explode(F.array_distinct(words)).alias("word")).withColumn("s", spec)
    return each.select("id", F.regexp_replace("s.path", r"^\./", "").alias("mention"), "s.first", "s.last").distinct()


def resolve(found: DataFrame, files: DataFrame) -> DataFrame:
    """Mentions -> with path and status: exact path, else the only file that ends in the mention at a folder's edge, else ambiguous or missing.

    Every suffix of a file's path is a key, so mentions meet files by an equi-join.
    """
    parts = F.split("path", "/")
    n = F.size(parts)
    suffixes = files.select("path", F.explode(F.transform(F.sequence(F.lit(1), n), lambda k: F.array_join(F.slice(parts, k, n), "/"))).alias("suffix"))
    keys = suffixes.groupBy("suffix").agg(F.count("*").alias("n"), F.min("path").alias("one"), F.max(F.when(F.col("suffix") == F.col("path"), F.col("path"))).alias("exact"))
    both = found.join(keys, F.col("mention") == F.col("suffix"), "left")
    status = F.when(F.col("exact").isNotNull() | (F.col("n") == 1), "resolved").when(F.col("n") > 1, "ambiguous").otherwise("missing")
    path = F.coalesce("exact", F.when(F.col("n") == 1, F.col("one")))
    return both.select(*found.columns, path.alias("path"), status.alias("status"))


#: Noise rules (fixed values): endings, folders, lock files, test-data folders, binary endings.
GENERATED_SUFFIXES = (".pb.go", ".pb.ts", ".gen.ts", ".gen.go", "_generated.py", "_pb2.py", ".min.js", ".bundle.js")
GENERATED_FOLDERS = ("dist", "build", ".next", "generated")
LOCK_FILES = ("package-lock.json", "pnpm-lock.yaml", "yarn.lock", "Cargo.lock", "Gemfile.lock", "go.sum", "poetry.lock", "composer.lock", "Pipfile.lock")
TEST_FOLDERS = ("testdata", "fixtures", "__fixtures__", "__snapshots__")
BINARY_ENDINGS = (".png", ".jpg", ".jpeg", ".gif", ".ico", ".pdf", ".zip", ".tar", ".gz", ".so", ".dylib", ".dll", ".exe", ".bin", ".wasm", ".woff", ".woff2", ".ttf", ".eot", ".mp3", ".mp4", ".mov")
DENSITY_ENDINGS = (".go", ".ts", ".tsx", ".js", ".jsx", ".mjs", ".py")


def _in_folder(path: Column, names: tuple[str, ...]) -> Column:
    return path.rlike("(?:^|/)(?:" + "|".join(n.replace(".", r"\.") for n in names) + ")/")


def noise(path: Column, size: Column, n_symbols: Column, dense: tuple[str, ...] = DENSITY_ENDINGS) -> Column:
    """generated, lockfile, testdata, binary, huge-json or low-density; null for none."""
    base = T.basename(path)
    ext = F.lower(F.regexp_extract(base, r"(\.[^.]*)$", 1))
    endings = base.rlike("(?:" + "|".join(s.replace(".", r"\.") for s in GENERATED_SUFFIXES) + ")$")
    return (
        F.when(endings | _in_folder(path, GENERATED_FOLDERS), "generated")
        .when(base.isin(*LOCK_FILES), "lockfile")
        .when(_in_folder(path, TEST_FOLDERS), "testdata")
        .when(ext.isin(*BINARY_ENDINGS), "binary")
        .when((ext == ".json") & (size >= 50 * 1024), "huge-json")
        .when(ext.isin(*dense) & (size >= 10 * 1024) & (n_symbols / (size / 1024) < 0.5), "low-density")
    )


def noise_summary(classified: DataFrame) -> DataFrame:
    """(path, tokens, reason) -> (files, tokens, ratio): of the rows with a reason; the ratio is of all tokens, 1 at most."""
    marked = F.col("reason").isNotNull()
    sums = classified.agg(F.count_if(marked).alias("files"), F.coalesce(F.sum(F.when(marked, F.col("tokens"))), F.lit(0)).cast("long").alias("tokens"), F.sum("tokens").alias("whole"))
    return sums.select("files", "tokens", F.when(F.col("whole") > 0, F.least(F.col("tokens") / F.col("whole"), F.lit(1.0))).otherwise(0.0).alias("ratio"))


def noise_globs(classified: DataFrame) -> DataFrame:
    """(glob) of the rows with a reason: three or more of one folder and ending become a glob."""
    rows = classified.where("reason is not null").select("path", T.dirname(F.col("path")).alias("dir"), F.regexp_extract("path", r"(\.[^./]*)$", 1).alias("ext"))
    sized = rows.withColumn("n", F.count("*").over(Window.partitionBy("dir", "ext")))
    glob = F.when(F.col("n") >= 3, F.concat("dir", F.lit("/*"), "ext")).otherwise(F.col("path"))
    return sized.select(glob.alias("glob")).distinct()


def onboarding(files: DataFrame, symbols: DataFrame, refs: DataFrame, limit: int = 10) -> DataFrame:
    """(rank, path, role, score): entry points 50, files with symbols 15; 3 log2(n + 1) for symbols, 15 at most; 20 for references as a share of the most."""
    counts = symbols.groupBy("path").agg(F.count("*").alias("n"))
    rows = files.select("path").join(counts, "path", "left").join(refs, "path", "left").select("path", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("refs", F.lit(0)).alias("refs"))
    most = refs.agg(F.greatest(F.coalesce(F.max("refs"), F.lit(0)), F.lit(1)).alias("most"))
    entry = T.role(F.col("path")) == "entry"
    base = F.when(entry, 50.0).when(F.col("n") > 0, 15.0).otherwise(0.0)
    words = F.when(F.col("n") > 0, F.least(3 * F.log2(F.col("n") + 1), F.lit(15.0))).otherwise(0.0)
    score = F.round(base + words + F.least(F.col("refs") / F.col("most") * 20, F.lit(20.0)), 2)
    scored = rows.crossJoin(F.broadcast(most)).select("path", F.when(entry, "entry").otherwise("core").alias("role"), score.alias("score"))
    best = scored.orderBy(F.desc("score"), "path").limit(limit)
    return best.select(F.row_number().over(Window.orderBy(F.desc("score"), "path")).alias("rank"), "path", "role", "score")


def fold_lines(diff_lines: DataFrame, around: int = 3) -> DataFrame:
    """(path, n, changed, text) -> (path, n, text, folded): lines within `around` of a change stay; each other run is one row with its length."""
    w = Window.partitionBy("path").orderBy("n")
    near = F.max(F.col("changed").cast("int")).over(w.rowsBetween(-around, around)) == 1
    marked = diff_lines.withColumn("near", near)
    run = F.col("n") - F.row_number().over(Window.partitionBy("path", "near").orderBy("n"))
    runs = marked.withColumn("run", run)
    shown = runs.where("near").select("path", "n", "text", F.lit(None).cast("long").alias("folded"))
    hidden = runs.where("not near").groupBy("path", "run").agg(F.min("n").alias("n"), F.count("*").alias("folded"))
    return shown.unionByName(hidden.select("path", "n", F.lit(None).cast("string").alias("text"), "folded"))


#: Characters of texts whose scripts a Python worker holds at once.
SCRIPT_CHARS = 2_000_000


def changed_lines(pairs: DataFrame) -> DataFrame:
    """(path, before, after) -> (path, n, op, text): a shortest line script; `=` kept, `-` gone, `+` new.

    A longest common subsequence needs both texts of a file in a task, whatever their length.
    Scripts are handed on after SCRIPT_CHARS of texts, whatever rows a batch has; a batch itself has 64 MB at most, as Spark cuts it.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    kind = pairs.schema["path"].dataType
    schema = pa.schema([("path", to_arrow_type(kind)), ("n", pa.int32()), ("op", pa.string()), ("text", pa.string())])

    def scripts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, ns, ops, texts, size = [], [], [], [], 0

            def done(batch=batch) -> pa.RecordBatch:
                paths = batch.column("path").take(pa.array(at, pa.int64()))  # noqa: B023
                return pa.RecordBatch.from_arrays([paths, *(pa.array(c, f.type) for c, f in zip((ns, ops, texts), list(schema)[1:], strict=True))], schema=schema)  # noqa: B023

            for k in range(batch.num_rows):
                before, after = batch.column("before")[k].as_py() or "", batch.column("after")[k].as_py() or ""
                for n, (op, text) in enumerate(line_script(before, after), 1):
                    at.append(k)
                    ns.append(n)
                    ops.append(op)
                    texts.append(text)
                size += len(before) + len(after)
                if size > SCRIPT_CHARS:
                    yield done()
                    at, ns, ops, texts, size = [], [], [], [], 0
            if at:
                yield done()

    return pairs.select("path", "before", "after").mapInArrow(scripts, f"path {kind.simpleString()}, n int, op string, text string")


def line_script(before: str, after: str, cells: int | None = None) -> list[tuple[str, str]]:
    """(op, line) by a longest common subsequence walked from the start, removals before additions.

    Texts of any length have a shortest script; only a caller that gives `cells` has all go and all come over so many.
    The walk asks at each mismatch whether the rest is as long without the line of `before`. Lines of one side alone never
    count for that. Once a side has only lines of the common tail left, all of them are kept, so the side with more gives one up.
    """
    a, b = text_lines(before), text_lines(after)
    if cells is not None and (len(a) + 1) * (len(b) + 1) > cells:
        return [("-", s) for s in a] + [("+", s) for s in b]
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    x, y = a[head:], b[head:]
    both = set(x) & set(y)
    p, q = [s for s in x if s in both], [s for s in y if s in both]
    tail = 0
    while tail < min(len(p), len(q)) and p[-1 - tail] == q[-1 - tail]:
        tail += 1
    codes: dict[str, int] = {}
    cp, cq = (np.array([codes.setdefault(s, len(codes)) for s in part[: len(part) - tail]], np.int32) for part in (p, q))
    drops = _drops(cp, cq)
    drop, low = next(drops, (0, 0))
    left, right = len(p), len(q)
    script, i, j = [("=", s) for s in a[:head]], 0, 0
    while i < len(x) and j < len(y):
        same = x[i] == y[j]
        if same or x[i] not in both:
            gone = True
        elif min(left, right) <= tail:
            gone = left > right
        else:
            gone = not drop >> max(right - tail - low, 0) & 1
        script.append(("=" if same else "-", x[i]) if gone else ("+", y[j]))
        if gone:
            if x[i] in both:
                left -= 1
                drop, low = next(drops, (0, 0))
            i += 1
        if same or not gone:
            right -= y[j] in both
            j += 1
    return script + [("-", s) for s in x[i:]] + [("+", s) for s in y[j:]]


#: Rows of bits that are kept at once for each level of `_drops`.
ROWS_KEPT = 512


def _drops(x: np.ndarray, y: np.ndarray) -> Iterator[tuple[int, int]]:
    """For each code of x in order (bits, low): bit k is set where the longest common subsequence with the last low + k of y falls without it.

    Rows of the usual table from the ends on, a bit a cell (Hyyro 2004): a row's clear bits tell where a length grows, the
    carries of its sum where it grows with the row. Matches count in a band that holds all paths of at most `edits`, which
    grows until the edits found fit. Rows are needed from the last back to the first, so some are kept and those between made again.
    """
    n, m, back = len(x), len(y), y[::-1]
    edits = abs(n - m) + 64

    def band(u: int) -> tuple[int, int]:
        return min(max(m - 1 - n + u - (edits - n + m) // 2, 0), m), min(m - n + u + (edits + n - m) // 2, m)

    def row(bits: int, u: int) -> tuple[int, int, int]:
        """Bits of row u - 1 -> carries of row u, its bits, and the lengths that left the band."""
        (lo, hi), (was, top) = band(u), band(u - 1)
        grown = (lo - was) - (bits & ((1 << (lo - was)) - 1)).bit_count()
        bits = bits >> (lo - was) | ((1 << (hi - top)) - 1) << (top - lo)
        hit = bits & int.from_bytes(np.packbits(back[lo:hi] == x[n - u], bitorder="little").tobytes(), "little")
        total, rest = bits + hit, bits ^ hit
        return total ^ rest, (total | rest) & ((1 << (hi - lo)) - 1), grown

    def first() -> int:
        lo, hi = band(0)
        return (1 << (hi - lo)) - 1

    def found() -> int:
        bits, length = first(), 0
        for u in range(1, n + 1):
            _, bits, grown = row(bits, u)
            length += grown
        lo, hi = band(n)
        return n + m - 2 * (length + hi - lo - bits.bit_count())

    def rows(start: int, stop: int, bits: int) -> Iterator[tuple[int, int]]:
        step, kept = -(-(stop - start) // ROWS_KEPT), []
        for u in range(start + 1, stop + 1):
            if step > 1 and (u - start - 1) % step == 0:
                kept.append((u - 1, bits))
            carries, bits, _ = row(bits, u)
            if step == 1:
                kept.append((u, carries))
        while kept:
            u, bits = kept.pop()
            if step == 1:
                yield bits, band(u)[0]
            else:
                yield from rows(u, min(u + step, stop), bits)

    if n and m:
        while edits < n + m and (most := found()) > edits:
            edits = min(4 * edits, most)
        yield from rows(0, n, first())


def text_lines(text: str) -> list[str]:
    """Lines parted at newlines alone, without a last empty one; carriage returns and form feeds stay in them."""
    return text.removesuffix("\n").split("\n") if text else []
