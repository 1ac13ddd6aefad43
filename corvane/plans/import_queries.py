"""Import edges over a tree of seven languages whose files are the documents."""

from __future__ import annotations

from string import Formatter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.operators import graph, imports
from corvane.plans.base import query, table

GO_MOD = "// the root\nmodule example.com/app\n\ngo 1.22\n"
COMPOSER = '{"autoload": {"psr-4": {"App\\\\": "src/", "App\\\\Lib\\\\": ["lib/", "lib2"]}}, "autoload-dev": {"psr-4": {"Tests\\\\": "tests"}}}'

#: Of document i: its language i % 7, its number n in it, its folder d of eight files; {t} is the document's text.
_BODIES = (
    'package p{d}\n\n// import "example.com/app/svc/p0"\nimport (\n\t"fmt"\n\tx "example.com/app/svc/p{e}" // next\n)\nimport _ "example.com/other/svc/p{e}"\n/* import "example.com/app/svc/p1" */\nfunc F() {{}}\nimport "example.com/app/svc/p2"\n/* {t} */\n',
    "<?php\n# use App\\Mod0\\C1;\nuse {php}\\{{C{j} as X, Missing}};\nuse function Other\\f;\nclass C{i} {{}}\n/* {t} */\n",
    "/* licence */\n// head\npackage com.acme.q{d};\n\nimport com.acme.q{f}.T{j};\nimport static com.acme.q{f}.T{j}.run;\nimport java.util.*;\nimport com.acme.q{e}.*;\nclass T{i} {{}}\n// {t}\n",
    '/*\n * licence\n */\n@file:JvmName("K")\npackage com.acme.k{d}\n\nimport com.acme.k{f}.K{j} as Z\nimport com.acme.k{e}.helper\nimport com.acme.k{e}.Gone\nclass K{i}\n/* {t} */\n',
    "from . import f{j}, gone\nfrom ..m{e} import nothing\nimport py.m{f}.f{j} as x, os\nx = 1  # import py.m0.f4\n'''{t}'''\n",
    "import {{x}} from './c{j}'\nexport * from \"../d{e}\"\n// import './c5'\nconst l = require('left-pad')\n/* {t} */\n",
    "import Foundation\nimport struct M{e}.X\nimport M{d}\n/* {t} */\n",
)
_PATHS = ("svc/p{d}/f{i}.go", "{root}/Mod{d}/C{i}.php", "src/main/java/com/acme/q{d}/T{i}.java", "app/K{i}.kt", "py/m{d}/{py}.py", "web/d{d}/{ts}", "Sources/M{d}/S{i}.swift")


def _filled(template: str, values: dict[str, Column]) -> Column:
    parts = []
    for text, name, _, _ in Formatter().parse(template):
        parts += [F.lit(text)] if text else []
        parts += [values[name].cast("string")] if name else []
    return F.concat(*parts)


def tree(documents: DataFrame) -> DataFrame:
    """documents -> files (path, body), with go.mod and composer.json at the root."""
    i = F.col("doc_id")
    n = F.floor(i / 7)
    d, f = F.floor(n / 8), F.floor((n + 1) / 8)
    kind, place = i % 7, n % 3
    root = F.when(place == 0, "src").when(place == 1, "lib").otherwise("lib2")
    php = F.concat(F.when((n + 1) % 3 == 0, "App\\Mod").otherwise("App\\Lib\\Mod"), f.cast("string"))
    values = {
        "i": i, "j": i + 7, "d": d, "e": d + 1, "f": f, "root": root, "php": php, "t": F.coalesce(F.regexp_replace("text", r"[*/'\"`#]|\b(?:import|use|package)\b", ""), F.lit("")),
        "py": F.when(n % 8 == 0, "__init__").otherwise(F.concat(F.lit("f"), i.cast("string"))),
        "ts": F.when(n % 8 == 0, "index.tsx").otherwise(F.concat(F.lit("c"), i.cast("string"), F.lit(".ts"))),
    }
    path = F.coalesce(*[F.when(kind == k, _filled(p, values)) for k, p in enumerate(_PATHS)])
    body = F.coalesce(*[F.when(kind == k, _filled(b, values)) for k, b in enumerate(_BODIES)])
    own = documents.where("doc_id is not null").select(path.alias("path"), body.alias("body"))
    roots = documents.sparkSession.createDataFrame([("go.mod", GO_MOD), ("composer.json", COMPOSER)], "path string, body string")
    return own.unionAll(roots)


_TREE = """t as (select doc_id as i, doc_id // 7 as n, doc_id // 56 as d, (doc_id // 7 + 1) // 8 as f, doc_id % 7 as kind from documents where doc_id is not null),
tree as (select distinct i, n, d, f, kind, case kind when 0 then concat('svc/p', d, '/f', i, '.go')
  when 1 then concat(case n % 3 when 0 then 'src' when 1 then 'lib' else 'lib2' end, '/Mod', d, '/C', i, '.php')
  when 2 then concat('src/main/java/com/acme/q', d, '/T', i, '.java') when 3 then concat('app/K', i, '.kt')
  when 4 then concat('py/m', d, '/', case when n % 8 = 0 then '__init__' else concat('f', i) end, '.py')
  when 5 then concat('web/d', d, '/', case when n % 8 = 0 then 'index.tsx' else concat('c', i, '.ts') end)
  else concat('Sources/M', d, '/S', i, '.swift') end as path from t),
edges as (
  select a.path as src, b.path as dst from tree a join tree b on a.kind = b.kind and (
    (a.kind in (0, 6) and b.d = a.d + 1) or (a.kind = 1 and b.i = a.i + 7)
    or (a.kind in (2, 3) and (b.i = a.i + 7 or b.d = a.d + 1))
    or (a.kind = 4 and ((b.i = a.i + 7 and b.n % 8 <> 0) or (b.d = a.d + 1 and b.n % 8 = 0)))
    or (a.kind = 5 and ((b.i = a.i + 7 and b.d = a.d and b.n % 8 <> 0) or (b.d = a.d + 1 and b.n % 8 = 0))))
  union select a.path, b.path from tree a join tree b on a.kind = 3 and b.kind = 3 and b.d = a.d + 1)"""


@query("j4_import_edges", f"with {_TREE} select src, dst from edges")
def j4(spark, sf_dir):
    return imports.import_edges(tree(table(spark, sf_dir, "documents")))


@query("j4_importers", f"with {_TREE} select dst, list_sort(list(distinct src)) as sources from edges group by dst")
def j4_importers(spark, sf_dir):
    return graph.reverse(j4(spark, sf_dir))


@query("r3_import_names", f"""with {_TREE}, s as (select distinct path, kind, d, f, i, n from tree where kind = 0)
select path, unnest(['fmt', concat('example.com/app/svc/p', d + 1), concat('example.com/other/svc/p', d + 1)]) as spec from s""")
def r3_names(spark, sf_dir):
    files = tree(table(spark, sf_dir, "documents")).where(F.col("path").endswith(".go")).distinct()
    return files.select("path", F.explode(imports.go_specs(F.col("body"))).alias("spec"))
