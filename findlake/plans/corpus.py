"""Source files derived from the `part` and `supplier` tables, and the findings that they must give.

Each part is a file of its brand's repository, made from a small template that its key chooses; each supplier is a
repository with a single file. EXPECTED says by hand what the rules find in each template.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from findlake.functions.text import with_raw
from findlake.operators.facts import project_facts
from findlake.plans.bindings import table
from findlake.schemas import SEVERITIES

_LONG = "".join(f"    total += step{i}\n" for i in range(90))
_NEST = "function deep() {\n" + "".join("  " * i + f"if (a{i}) {{\n" for i in range(1, 6)) + "}}}}}\n}\n"

#: (path with @K for the part's key, language, text)
TEMPLATES: tuple[tuple[str, str, str], ...] = (
    ("src/db@K.js", "javascript", "const id = req.query.id;\nconst sql = `SELECT * FROM t WHERE id = ${req.query.id}`;\nawait db.query(sql);\n"),
    ("src/safe@K.js", "javascript", 'db.query("SELECT * FROM t WHERE id = ?", [id]);\n'),
    ("app/raw@K.py", "python", "month = request.data['month']\nprint(1)\nT.objects.raw('SELECT * FROM t WHERE m=%s' % month)\n"),
    ("app/other@K.py", "python", "x = request.args['x']\ndb.execute('SELECT * FROM t WHERE m=' + name)\n"),
    ("static/js/lib@K.js", "javascript", "db.query(`SELECT ${req.query.id}`);\n"),
    ("src/run@K.js", "javascript", "const a = 1;\nexec(`ls ${req.query.dir}`);\n"),
    ("src/spawn@K.js", "javascript", "spawn(`ls ${dir}`);\nspawn(`ls ${dir}`, { shell: true });\n"),
    ("src/eval@K.ts", "typescript", "const x: number = 1;\neval(req.body.code);\n"),
    ("app/ev@K.py", "python", "# eval(request.args['a'])\nexec('a' + name)\neval('1')\n"),
    ("src/read@K.js", "javascript", "fs.readFile(req.query.path, cb);\n"),
    ("src/guard@K.js", "javascript", "fs.readFile(path.basename(req.query.path), cb);\n"),
    ("app/open@K.py", "python", "data = 1\nopen(request.args['f'])\n"),
    ("src/fetch@K.js", "javascript", "fetch(req.query.url);\n"),
    ("app/get@K.py", "python", "requests.get('https://a.example/x')\nurllib.request.urlopen(url)\n"),
    ("src/hash@K.js", "javascript", "// the password\nconst p = createHash('md5').update(password);\nconst e = createHash('md5').update(etag);\n\n\n"),
    ("app/hash@K.py", "python", "h = hashlib.sha1(token)\n"),
    ("src/rand@K.js", "javascript", "const token = Math.random();\nconst jitter = Math.random();\n"),
    ("src/cors@K.js", "javascript", "app.use(cors({\n  origin: '*',\n  credentials: true,\n}));\n"),
    ("src/cors_ok@K.js", "javascript", "app.use(cors({ origin: '*' }));\n"),
    ("src/jwt@K.js", "javascript", "const t = jwt.decode(x);\n"),
    ("app/jwt@K.py", "python", "t = jwt.decode(x, key, algorithms=['HS256'])\nrequests.get(u, verify=False)\n"),
    ("app/default@K.py", "python", "def one(a=[]):\n    pass\n\ndef two(\n    a,\n    b={},\n):\n    pass\n\ndef ok(a=None):\n    b = []\n"),
    ("app/except@K.py", "python", "try:\n    a()\nexcept:\n    b()\nexcept ValueError:\n    c()\n"),
    ("app/shell@K.py", "python", "subprocess.run(cmd, shell=True)\nos.system(cmd)\nsubprocess.run(['ls'])\n# os.system(x)\n"),
    ("app/load@K.py", "python", "yaml.load(f)\nyaml.load(f, Loader=L)\npickle.loads(b)\nyaml.safe_load(f)\n"),
    ("tests/test_load@K.py", "python", "pickle.loads(b)\n"),
    ("src/long@K.txt", "markdown", "line\n" * 650),
    ("src/huge@K.txt", "markdown", "line\n" * 1200),
    ("app/func@K.py", "python", "def big(a):\n" + _LONG + "\ndef small():\n    return 1\n"),
    ("src/nest@K.js", "javascript", _NEST),
    ("src/flat@K.js", "javascript", "const a = { b: { c: { d: { e: { f: 1 } } } } };\n"),
    ("src/todo@K.py", "python", "# TODO: one\nx = 1  # FIXME two\n"),
    ("src/list@K.jsx", "javascript", "const A = () => (\n  <ul>\n    {items.map((x) => (\n      <li>{x}</li>\n    ))}\n  </ul>\n);\n"),
    ("src/keyed@K.jsx", "javascript", "const A = () => items.map((x) => <li key={x.id}>{x}</li>);\nconst B = items.map((x) => [x, 1]);\n"),
    ("src/index@K.jsx", "javascript", "const A = () => items.map((x, index) => <li key={index}>{x}</li>);\n"),
    ("src/html@K.tsx", "typescript", "// dangerouslySetInnerHTML\nconst A = () => <p dangerouslySetInnerHTML={{ __html: x }} />;\n"),
    ("pkg@K/tsconfig.json", "json", '{\n  "compilerOptions": {\n    "strict": false\n  }\n}\n'),
    ("strict@K/tsconfig.json", "json", '{ "compilerOptions": { "strict": true } }\n'),
    ("loose@K/tsconfig.json", "json", "{}\n"),
    ("src/keys@K.py", "python", 'a = 1\nkey = "AKIA@A"\n'),
    ("src/conf@K.py", "python", 'password = "hunter2hunter2"\napi_key = "q8Zr4Tw1Yx9Kp3Lm@K"\nsecret = "changeme-please"\n'),
    ("tests/certs/key@K.txt", "markdown", "-----BEGIN RSA PRIVATE KEY-----\n"),
)

#: (template, rule, line, severity, confidence)
EXPECTED: tuple[tuple[int, str, int, str, str], ...] = (
    (0, "security/sql-injection", 2, "critical", "high"),
    (2, "security/sql-injection", 3, "critical", "high"),
    (3, "security/sql-injection", 2, "medium", "medium"),
    (5, "security/command-injection", 2, "critical", "high"),
    (6, "security/command-injection", 1, "medium", "medium"),
    (7, "security/code-injection", 2, "critical", "high"),
    (8, "security/code-injection", 2, "high", "medium"),
    (9, "security/path-traversal", 1, "high", "high"),
    (11, "security/path-traversal", 2, "high", "high"),
    (12, "security/ssrf", 1, "high", "high"),
    (14, "security/weak-hash", 2, "high", "medium"),
    (15, "security/weak-hash", 1, "high", "medium"),
    (16, "security/insecure-random", 1, "high", "high"),
    (17, "security/permissive-cors", 2, "high", "high"),
    (19, "security/jwt-unverified", 1, "critical", "high"),
    (20, "security/jwt-unverified", 1, "critical", "high"),
    (21, "python/mutable-default-argument", 1, "medium", "high"),
    (21, "python/mutable-default-argument", 4, "medium", "high"),
    (22, "python/bare-except", 3, "low", "high"),
    (23, "python/subprocess-shell", 1, "medium", "medium"),
    (23, "python/subprocess-shell", 2, "medium", "medium"),
    (24, "python/unsafe-deserialisation", 1, "high", "medium"),
    (24, "python/unsafe-deserialisation", 3, "high", "medium"),
    (26, "quality/long-file", 1, "low", "high"),
    (27, "quality/long-file", 1, "medium", "high"),
    (28, "quality/long-function", 1, "low", "medium"),
    (29, "quality/deep-nesting", 6, "low", "medium"),
    (32, "react/missing-list-key", 3, "medium", "medium"),
    (34, "react/array-index-key", 1, "low", "medium"),
    (35, "react/dangerously-set-inner-html", 2, "medium", "low"),
    (36, "config/ts-not-strict", 3, "medium", "high"),
    (38, "config/ts-not-strict", 1, "medium", "high"),
    (39, "security/hardcoded-secret", 2, "critical", "high"),
    (40, "security/hardcoded-secret", 2, "high", "medium"),
    (41, "security/hardcoded-secret", 1, "critical", "medium"),
)

#: A brand's number decides which further files its repository has: (path, language, text, divisor); 5 means "not divisible by 5".
MANIFESTS = (
    ("package.json", "json", '{"dependencies": {"react": "^19.1.0", "react-dom": "^18.2.0"}, "scripts": {"build": "x"}}', -5),
    ("README.md", "markdown", "# read me\n", 2),
    (".github/workflows/ci.yml", "yaml", "on: push\n", 3),
    ("eslint.config.js", "javascript", "export default [];\n", 4),
    ("package-lock.json", "json", "{}", 6),
    (".env", None, "A=1\n", 7),
    (".gitignore", None, "node_modules\n.env\n", 14),
)


def source_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(repo, path, language, text)."""
    shape = "t int, path string, language string, text string"
    templates = spark.createDataFrame([(i, *t) for i, t in enumerate(TEMPLATES)], shape)
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    filled = lambda c: F.replace(F.replace(F.col(c), F.lit("@K"), F.col("p_partkey").cast("string")), F.lit("@A"), F.lpad(F.translate(F.col("p_partkey").cast("string"), "0123456789", "ABCDEFGHIJ"), 16, "Z"))
    made = parts.join(F.broadcast(templates), F.col("p_partkey") % len(TEMPLATES) == F.col("t")).select(F.col("p_brand").alias("repo"), filled("path").alias("path"), "language", filled("text").alias("text"))
    number = F.regexp_extract("p_brand", r"(\d+)", 1).cast("int")
    extra = spark.createDataFrame(list(MANIFESTS), "path string, language string, text string, divisor int")
    holds = F.when(F.col("divisor") < 0, F.col("n") % -F.col("divisor") != 0).otherwise(F.col("n") % F.col("divisor") == 0)
    more = parts.select(F.col("p_brand").alias("repo"), number.alias("n")).distinct().join(F.broadcast(extra), holds).select("repo", "path", "language", "text")
    bare = table(spark, sf_dir, "supplier").select(F.concat(F.lit("supplier"), "s_suppkey").alias("repo"), F.lit("main.py").alias("path"), F.lit("python").alias("language"), F.lit("print(1)\n").alias("text"))
    return made.union(more).union(bare)


def advisories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges of advisories about two packages that the derived repositories declare, one for each supplier."""
    s = F.col("s_suppkey")
    severity = F.element_at(F.array(*map(F.lit, SEVERITIES)), (F.col("s_nationkey") % len(SEVERITIES) + 1).cast("int"))
    return table(spark, sf_dir, "supplier").select(
        F.lit("npm").alias("ecosystem"),
        F.when(s % 2 == 0, "react").otherwise("react-dom").alias("name"),
        F.concat(F.lit("ADV-"), F.lpad(s.cast("string"), 8, "0")).alias("id"),
        severity.alias("severity"),
        F.concat(s % 19, F.lit(".0.0")).alias("introduced"),
        F.when(s % 3 > 0, F.concat(s % 19 + 4, F.lit(".0.0"))).alias("fixed"),
        F.concat(F.lit("Problem "), s).alias("summary"),
        F.array().cast("array<string>").alias("aliases"),
    )


#: Lines of files that are made from line items: a file for each order, a line for each item by its part; @K is the part's
#: key and @Q the item's quantity. Braces and brackets close where it happens.
WEB_LINES = ("function f@K(a) {", "if (a > @Q) {", "const o = {", "}", "}", "items.map((x) => (", "<li>{x}</li>", "))")
PYTHON_LINES = ("def f@K(a,", "  b=[],", "):", "    return a", "def g@K(a, b={}):", "", "x = 1", "  y = (2)")


def order_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(repo, path, language, text): orders of even number in Python, the others in JavaScript."""
    p, q = F.col("l_partkey").cast("int") % 8, F.col("l_quantity").cast("int")
    lines = F.when(F.col("l_orderkey") % 2 == 0, F.get(F.array(*map(F.lit, PYTHON_LINES)), p)).otherwise(F.get(F.array(*map(F.lit, WEB_LINES)), p))
    line = F.replace(F.replace(lines, F.lit("@K"), F.col("l_partkey").cast("string")), F.lit("@Q"), q.cast("string"))
    of = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", q.alias("q"), line.alias("line")))).alias("rows"))
    language = F.when(F.col("l_orderkey") % 2 == 0, "python").otherwise("javascript")
    text = F.concat(F.array_join(F.transform("rows", lambda r: r["line"]), "\n"), F.lit("\n"))
    return of.select(F.col("l_orderkey").alias("repo"), F.concat(F.lit("src/order"), "l_orderkey").alias("path"), language.alias("language"), text.alias("text"))


def lines_and_facts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    files = source_files(spark, sf_dir)
    return with_raw(files), project_facts(files)
