"""Import resolution by language: packages, roots, fallbacks and what does not count."""

import pytest
from pyspark.sql import functions as F

from corvane.operators import imports


def edges(spark, files):
    table = spark.createDataFrame(list(files.items()), "path string, body string")
    return sorted(tuple(r) for r in imports.import_edges(table).collect())


def test_go_packages(spark):
    files = {
        "go.mod": "module example.com/m\n\ngo 1.22\n", "lib/a.go": "package lib\n", "lib/b_test.go": "package lib", "root.go": "package m", "other/c.go": "package other",
        "main.go": 'package main\nimport "example.com/m/lib" // one\n', "cmd/x.go": 'package x\nimport (\n\t. "example.com/m"\n\t_ `example.com/m/other`\n\t"example.com/mm/lib"\n)\n',
        "late.go": 'package m\nvar s = "// no"\nimport "example.com/m/lib"\n', "note.go": 'package m\n/* import "example.com/m/lib"\n*/\n// import "example.com/m/other"\n',
    }
    assert edges(spark, files) == [("cmd/x.go", "late.go"), ("cmd/x.go", "main.go"), ("cmd/x.go", "note.go"), ("cmd/x.go", "other/c.go"), ("cmd/x.go", "root.go"), ("main.go", "lib/a.go"), ("main.go", "lib/b_test.go")]
    assert not edges(spark, {k: v for k, v in files.items() if k != "go.mod"})


@pytest.mark.parametrize(("source", "specs"), [
    ('package a\nimport x "a/b"\nimport ("c"\n "d//e" // f\n)\nfunc f() {}\nimport "g"', ["a/b", "c", "d//e"]), ("", []), ('import "a/func/b"\nimport "type"\n', ["a/func/b", "type"]),
    ("package a\n// " + "x" * 20000 + '\nimport "b"\nconst c = "' + "\\\\" * 20000 + '"', ["b"]),
])
def test_go_heads(spark, source, specs):
    df = spark.createDataFrame([(source,)], "s string")
    assert df.select(imports.go_specs(F.col("s"))).first()[0] == specs


def test_composer_roots(spark):
    files = {
        "composer.json": '{"autoload": {"psr-4": {"App\\\\": "src/", "App\\\\Lib\\\\": ["lib", "more/"], "": "any"}}, "autoload-dev": {"psr-4": {"App\\\\": "dev"}}}',
        "src/A.php": "", "src/Lib/Only.php": "", "lib/B.php": "", "more/C.php": "", "dev/D.php": "", "any/Else/E.php": "",
        "x.php": "<?php\nuse App\\A; use App\\Skipped;\nuse App\\{Lib\\B as Z, Lib\\C,\n Lib\\Only};\nuse function \\App\\D as f;\nuse Else\\E;\n// use App\\Gone;\n/* use App\\Lib; */\n",
    }
    assert edges(spark, files) == [("x.php", p) for p in ("any/Else/E.php", "dev/D.php", "lib/B.php", "more/C.php", "src/A.php", "src/Lib/Only.php")]


def test_jvm_packages(spark):
    files = {
        "src/main/java/a/b/One.java": "/* l */\n// c\npackage a.b;\nclass One {}", "src/main/java/a/b/Two.java": "/*\n * l\n */\n@X\npackage a.b ;\n", "k/F.kt": "package a.b\nfun helper() {}", "No.java": "class No {} package x;",
        "U.java": "package u;\nimport a.b.One;\nimport static a.b.Two.run;\nimport a.c.*;\n", "W.java": "import a.b.*;", "f.kt": "import a.b.helper\nimport a.b.Missing\n", "g.kt": "import a.b.One as Z\nimport No\n",
    }
    package = ["k/F.kt", "src/main/java/a/b/One.java", "src/main/java/a/b/Two.java"]
    want = [("U.java", package[1]), ("U.java", package[2]), *[("W.java", p) for p in package], *[("f.kt", p) for p in package], ("g.kt", "No.java"), ("g.kt", package[1])]
    assert edges(spark, files) == sorted(want)


def test_python_modules(spark):
    files = {
        "p/__init__.py": "", "p/x.py": "", "p/q/__init__.py": "", "p/q/y.py": "from . import z, gone\nfrom .. import x as w\nfrom ..q import (z)\nfrom ... import top\nfrom .... import above\n", "p/q/z.py": "", "top.py": "",
        "m.py": "import p.x, p.q as r, os\nfrom p import nothing, *\nfrom p.q.z import name\nt = 1 # import top\n", "n.py": "def f():\n    from p import x\n",
    }
    want = [("m.py", "p/__init__.py"), ("m.py", "p/q/__init__.py"), ("m.py", "p/q/z.py"), ("m.py", "p/x.py"), ("n.py", "p/x.py"), ("p/q/y.py", "p/q/z.py"), ("p/q/y.py", "p/x.py"), ("p/q/y.py", "top.py")]
    assert edges(spark, files) == want


def test_scripts_and_swift(spark):
    files = {
        "a/b.ts": "import x from './c'; // import y from './d'\nexport * from '../e'\nrequire('./f.js'); import('.')\nimport 'pkg'", "a/c.tsx": "", "a/c.js": "", "a/d.ts": "", "e/index.js": "", "a/f.js": "", "a/index.ts": "",
        "v.vue": "<p>import './a/d'</p><script lang=ts>import './a/c'</script>", "Sources/A/x.swift": "import struct B.C\nimport A\nimport Foundation", "Sources/B/y.swift": "", "Sources/B/z.swift": "", "B/w.swift": "",
    }
    want = [("Sources/A/x.swift", "Sources/B/y.swift"), ("Sources/A/x.swift", "Sources/B/z.swift"), ("a/b.ts", "a/c.tsx"), ("a/b.ts", "a/f.js"), ("a/b.ts", "a/index.ts"), ("a/b.ts", "e/index.js"), ("v.vue", "a/c.tsx")]
    assert edges(spark, files) == want


def test_nothing_to_resolve(spark):
    assert edges(spark, {}) == [] and edges(spark, {"a.go": None, "b.txt": "import x", "composer.json": "{broken"}) == []
