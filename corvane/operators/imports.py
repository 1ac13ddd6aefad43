"""Import edges between files: every import becomes ordered candidate names, every file has names, and both meet by equality.

Names are paths, Go package folders, JVM packages and classes, and Swift modules. Of an import, the first candidate that any file
has counts, with all files that have it. Composer roots take part as candidates of every prefix of a class name, the
longest first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import text as T

#: Import statements (fixed values); those of Python, Java and PHP are read again by their parts.
SCRIPT = (r"""\b(?:import|export)\b[^'"\n;]*?(?:from\s*)?['"]([^'"\n]+)['"]""", r"""\b(?:import|require)\b\s*\(\s*['"]([^'"\n]+)['"]\s*\)""")
PYTHON = r"(?dm)^\s*(?:from\s+(\.*)([A-Za-z_][\w.]*)?\s+import\s+([^\n#]+)|import\s+([^\n#]+))"
JAVA = r"(?dm)^\s*import\s+(static\s+)?([\w.]+(?:\.\*)?)\s*;"
KOTLIN = r"(?dm)^\s*import\s+([\w.]+(?:\.\*)?)(?:\s+as\s+\w+)?\s*$"
PHP = r"(?dm)^\s*use\s+(?:function\s+|const\s+)?([^;]+);"
SWIFT = r"(?dm)^\s*import\s+(?:struct\s+|class\s+|enum\s+|protocol\s+|typealias\s+|func\s+|var\s+|let\s+)?([A-Za-z_]\w*)"
#: Endings tried for a relative script import, in order, and again for its index file (fixed values).
SCRIPT_ENDINGS = (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".svelte", ".vue", ".d.ts")
#: A Go file's texts, comments and other parts; what can stand in its head; and the words that end the head (fixed values).
GO_PARTS = r'("[^"\\]*+(?:\\.[^"\\]*+)*+"?|`[^`]*+`?|//[^\n]*+|/\*(?s:.*?)(?:\*/|\z)|[^"`/]++|/)'
GO_HEAD = r"(import[ \t]*\([^)]*\)?[^\n]*|import(?![A-Za-z0-9_])[^\n]*|(?:func|type|var|const)(?![A-Za-z0-9_]))"
GO_SPEC = r"""(?dm)^\s*(?:[._]|[A-Za-z]\w*)?[ \t]*(?:"([^"\n]*)"|`([^`\n]*)`)"""


def _tries(names: list[Column]) -> Column:
    return F.array(*[F.struct(n.alias("key"), F.lit(k).cast("long").alias("k")) for k, n in enumerate(names)])


def _endings(place: Column, endings: list[str]) -> Column:
    """A path with each of the endings in turn."""
    known = F.split(F.lit("\n".join(endings)), "\n")
    return F.transform(known, lambda e, k: F.struct(F.concat(F.lit("path:"), place, e).alias("key"), k.cast("long").alias("k")))


def _all(source: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(source, F.lit(pattern), F.lit(group))


def _strip(name: Column) -> Column:
    return F.regexp_replace(name, r"^\s+|\s+$", "")


def _folder(path: Column) -> Column:
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


def _named(kind: str, name: Column) -> Column:
    return F.concat(F.lit(f"{kind}:"), name)


def go_specs(source: Column) -> Column:
    """The import paths of a Go file's head: comments left out, texts kept, up to its first declaration."""
    parts = F.transform(_all(source, GO_PARTS), lambda p: F.when(p.startswith("//"), "").when(p.startswith("/*"), F.regexp_replace(p, r"[^\n]", "")).otherwise(p))
    head = _all(F.array_join(parts, ""), GO_HEAD)
    stop = F.array_position(F.transform(head, lambda p: p.isin("func", "type", "var", "const")), F.lit(True))
    head = F.when(stop > 0, F.slice(head, F.lit(1), F.greatest(stop - 1, F.lit(0)).cast("int"))).otherwise(head)
    lines = F.transform(head, lambda p: F.regexp_replace(p, r"^import[ \t]*\(?", ""))
    found = F.flatten(F.transform(lines, lambda p: F.when(p.startswith("("), F.array().cast("array<string>")).otherwise(_all(p, GO_SPEC, 0))))
    return F.transform(found, lambda s: F.regexp_extract(s, r"""["`]([^"`\n]*)["`]$""", 1))


def _script(path: Column, source: Column) -> Column:
    plain = T.strip_comments(source)
    specs = F.filter(F.concat(*[_all(plain, p) for p in SCRIPT]), lambda s: s.isin(".", "..") | s.startswith("./") | s.startswith("../"))

    folder = _folder(path)
    joined = F.transform(specs, lambda s: T.clean_path(F.when(folder == "", s).otherwise(F.concat(folder, F.lit("/"), s))))
    return F.transform(joined, lambda at: _endings(F.when(at == ".", "").otherwise(at), ["", *SCRIPT_ENDINGS, *[f"/index{e}" for e in SCRIPT_ENDINGS]]))


def _python(path: Column, source: Column) -> Column:
    folders = F.filter(F.split(_folder(path), "/"), lambda s: s != "")

    def clean(name: Column) -> Column:
        return _strip(F.regexp_replace(_strip(F.regexp_replace(name, r" as .*$", "")), r"^\(+|\)+$", ""))

    def parts(stmt: Column) -> Column:
        """The folder names are relative to, null above the root; the module; whether it stands alone; the names."""
        dots, plain = F.length(F.regexp_extract(stmt, PYTHON, 1)), F.regexp_extract(stmt, PYTHON, 4)
        up = F.size(folders) - dots + 1
        base = F.when(dots == 0, "").when((up >= 0) & (dots > 0), F.array_join(F.slice(folders, F.lit(1), F.greatest(up, F.lit(0))), "/"))
        names = F.transform(F.split(F.when(plain != "", plain).otherwise(F.regexp_extract(stmt, PYTHON, 3)), ","), clean)
        return F.struct(
            base.alias("base"), F.translate(F.regexp_extract(stmt, PYTHON, 2), ".", "/").alias("of"), F.filter(names, lambda n: ~n.isin("", "*")).alias("names")
        )

    def places(stmt: Column) -> Column:
        """Of each name the module it may be, and the module it may be in."""
        base, of = stmt["base"], stmt["of"]
        below = F.when(base == "", "").otherwise(F.concat(base, F.lit("/")))
        inner = F.when(of == "", below).otherwise(F.concat(below, of, F.lit("/")))
        return F.transform(stmt["names"], lambda n: F.struct(F.concat(inner, F.translate(n, ".", "/")).alias("own"), F.when(of != "", F.concat(below, of)).alias("of")))

    def tries(place: Column) -> Column:
        return _tries([_named("path", F.concat(place[at], F.lit(e))) for at in ("own", "of") for e in (".py", "/__init__.py")])

    return F.transform(F.flatten(F.transform(F.transform(_all(source, PYTHON, 0), parts), places)), tries)


def _jvm(source: Column, kotlin: bool) -> Column:
    def tries(stmt: Column) -> Column:
        spec = F.regexp_extract(stmt, KOTLIN, 1) if kotlin else F.regexp_extract(stmt, JAVA, 2)
        up = F.when(spec.rlike(r"[^.]\."), F.regexp_replace(spec, r"\.[^.]*$", ""))
        exact = spec if kotlin else F.when(F.regexp_extract(stmt, JAVA, 1) != "", F.coalesce(up, spec)).otherwise(spec)
        wild = spec.endswith(".*")
        package = F.when(wild, F.regexp_replace(spec, r"(?:\.\*)+$", ""))
        if kotlin:  # a function of a package: any of its files may have it
            package = package.when(spec.rlike(r"\.[a-z][^.]*$"), up)
        return _tries([_named("class", F.when(~wild, exact)), _named("package", package)])

    return F.transform(_all(source, KOTLIN if kotlin else JAVA, 0), tries)


def _php(source: Column, roots: Column) -> Column:
    """A class below each root whose prefix it has, the longest prefix first, then in the order of composer.json."""
    plain = F.regexp_replace(T.strip_comments(source), r"#[^\n]*", "")

    def bare(name: Column) -> Column:
        return _strip(F.regexp_replace(_strip(name), r"(?is) as .*$", ""))

    def names(body: Column) -> Column:
        head, inner = F.regexp_extract(body, r"^([^{]*)\{", 1), F.regexp_extract(body, r"\{([^}]*)\}", 1)
        listed = F.transform(F.filter(F.transform(F.split(inner, ","), bare), lambda n: n != ""), lambda n: F.concat(F.regexp_replace(_strip(head), r"\\+$", ""), F.lit("\\"), n))
        return F.when(body.rlike(r"(?s)\{[^}]*\}"), listed).otherwise(F.array(bare(body)))

    def tries(name: Column) -> Column:
        under = F.filter(roots, lambda r: F.startswith(name, r["prefix"]) & (F.length(name) > F.length(r["prefix"])))
        rest = lambda r: F.concat(F.lit("path:"), r["dir"], F.translate(F.substr(name, F.length(r["prefix"]) + 1), "\\", "/"), F.lit(".php"))
        return F.transform(under, lambda r: F.struct(rest(r).alias("key"), (r["at"] - F.length(r["prefix"]) * F.lit(1_000_000)).cast("long").alias("k")))

    classes = F.transform(F.flatten(F.transform(_all(plain, PHP), names)), lambda c: F.regexp_replace(c, r"^\\+", ""))
    return F.transform(classes, tries)


def _swift_module(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.when((F.size(parts) >= 3) & (F.get(parts, F.lit(0)) == "Sources"), F.get(parts, F.lit(1)))


def root_settings(files: DataFrame) -> DataFrame:
    """One row (module, roots): the module path of the root's go.mod, and namespace roots (prefix, dir, at) of its composer.json."""
    module = F.trim(F.regexp_extract("body", r"(?dm)^[ \t]*module[ \t]([^\n]*)", 1))
    sections = F.array(*[F.map_entries(F.from_json(F.get_json_object("body", f"$['{s}']['psr-4']"), "map<string,string>")) for s in ("autoload", "autoload-dev")])

    def root(entry: Column, section: Column) -> Column:
        dirs = F.when(entry["value"].startswith("["), F.from_json(entry["value"], "array<string>")).otherwise(F.array(entry["value"]))
        clean = F.transform(dirs, lambda d: F.regexp_replace(F.translate(d, "\\", "/"), "/+$", ""))
        return F.transform(clean, lambda d, k: F.struct(entry["key"].alias("prefix"), F.when(d == "", "").otherwise(F.concat(d, F.lit("/"))).alias("dir"), (section * 1000 + k).alias("at")))

    listed = F.transform(sections, lambda s, k: F.flatten(F.transform(F.coalesce(s, F.array().cast("array<struct<key:string,value:string>>")), lambda e: root(e, k))))
    settings = files.where("path in ('go.mod', 'composer.json')").select("path", module.alias("module"), F.flatten(listed).alias("roots"))
    return settings.agg(
        F.max(F.when((F.col("path") == "go.mod") & (F.col("module") != ""), F.col("module"))).alias("module"),
        F.coalesce(F.max(F.when(F.col("path") == "composer.json", F.col("roots"))), F.array().cast("array<struct<prefix:string,dir:string,at:int>>")).alias("roots"),
    )


def import_names(files: DataFrame) -> DataFrame:
    """files (path, body) -> (src, no, key, k): each import's candidate names, the smallest k first. The root's settings are one row."""
    path, source = F.col("path"), F.coalesce("body", F.lit(""))
    ext = F.lower(F.regexp_extract("path", r"\.([A-Za-z]+)$", 1))
    blocks = F.array_join(_all(source, T.SCRIPT_BLOCK), "\n")
    own = F.coalesce(_swift_module(path), F.lit(""))
    module = F.concat("module", F.lit("/"))
    packages = F.filter(F.transform(go_specs(source), lambda s: F.concat(s, F.lit("/"))), lambda s: F.startswith(s, module))
    is_script = ext.isin("ts", "tsx", "js", "jsx", "mjs", "cjs", "svelte", "vue")
    found = (
        F.when(ext == "go", F.transform(packages, lambda s: _tries([_named("go", F.regexp_replace(F.substr(s, F.length(module) + 1), "/$", ""))])))
        .when(is_script, _script(path, F.when(ext.isin("svelte", "vue"), blocks).otherwise(source)))
        .when(ext == "py", _python(path, source))
        .when(ext == "java", _jvm(source, False))
        .when(ext.isin("kt", "kts"), _jvm(source, True))
        .when(ext == "php", _php(source, F.col("roots")))
        .when(ext == "swift", F.transform(F.filter(_all(source, SWIFT), lambda m: m != own), lambda m: _tries([_named("swift", m)])))
    )
    each = files.crossJoin(F.broadcast(root_settings(files))).select(path.alias("src"), F.posexplode(found).alias("no", "tries"))
    return each.select("src", "no", F.inline("tries")).where("key is not null")


def file_names(files: DataFrame) -> DataFrame:
    """files -> (key, dst): the names imports can give a file. A class that several files have belongs to the first path."""
    path, source = F.col("path"), F.coalesce("body", F.lit(""))
    ext = F.lower(F.regexp_extract("path", r"\.([A-Za-z]+)$", 1))
    plain = F.regexp_replace(F.regexp_replace(source, r"(?dm)^[ \t]*/\*(?:(?!\*/)[^\n])*+\*/[^\n]*", ""), r"(?dm)^[ \t]*/\*(?s:.*?)(?:\*/|\z)", "")
    package = F.trim(F.regexp_extract(plain, r"(?d)^(?:\s*+(?://|@)[^\n]*+\n)*+\s*+package[ \t]+([^\n;]*)", 1))
    base = F.regexp_replace(F.regexp_extract("path", "[^/]*$", 0), r"\.[^.]*$", "")
    is_jvm = ext.isin("java", "kt", "kts")
    keys = F.array(
        _named("path", path), F.when(ext == "go", _named("go", _folder(path))), F.when(is_jvm, _named("package", package)),
        F.when(is_jvm, _named("class", F.concat_ws(".", F.when(package != "", package), base))), F.when(ext == "swift", _named("swift", _swift_module(path))),
    )
    rows = files.select(F.explode(F.array_compact(keys)).alias("key"), path.alias("dst"))
    classes = rows.where(F.col("key").startswith("class:")).groupBy("key").agg(F.min("dst").alias("dst"))
    return rows.where(~F.col("key").startswith("class:")).unionAll(classes)


def import_edges(files: DataFrame) -> DataFrame:
    """files (path, body) -> (src, dst), each once; files of one root, whose go.mod and composer.json are among them.

    Only names are shuffled, no body. A file may import itself (a package's wildcard); files without an edge are not listed.
    """
    met = import_names(files).join(file_names(files), "key")
    first = F.min("k").over(Window.partitionBy("src", "no"))
    return met.withColumn("first", first).where("k = first").select("src", "dst").distinct()
