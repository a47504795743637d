"""Sources: file trees, byte order marks, audit logs, configurations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Folders that a scan skips, and extensions that it reads.
SKIPPED = ["node_modules", ".git", "dist", "build", ".next", "coverage", "__pycache__", ".gradle", "target", "out", ".idea", ".vscode", "graphify-out", "graphify_out", "vendor", "venv", ".venv"]
EXTENSIONS = "ts tsx js jsx mjs cjs py java kt go rs rb php json yml yaml toml ini cfg conf sh bash zsh html css scss sql md txt properties xml gradle kts".split()


def decode_with_bom(content: Column) -> Column:
    head = lambda n: F.hex(F.substring(content, 1, n))
    rest = lambda n: F.substring(content, n + 1, 2**31 - 1)
    return F.when(head(3) == "EFBBBF", F.decode(rest(3), "UTF-8")).when(head(2) == "FFFE", F.decode(rest(2), "UTF-16LE")).when(head(2) == "FEFF", F.decode(rest(2), "UTF-16BE")).otherwise(content.cast("string"))


def one_text(spark: SparkSession, text: str | None = None, path: str | None = None) -> DataFrame:
    """A text, or a file's, or standard input's, as a table of one document (doc_id, text)."""
    if path is not None:
        return spark.read.format("binaryFile").load(path).select(F.lit(0).cast("long").alias("doc_id"), decode_with_bom(F.col("content")).alias("text"))
    if text is None:
        import sys

        text = sys.stdin.read()
    return spark.createDataFrame([(0, text)], "doc_id long, text string")


# Files that tell a project's language, and words that name no company.
MANIFESTS = {"package.json": "typescript", "tsconfig.json": "typescript", "pom.xml": "java", "build.gradle": "java", "build.gradle.kts": "kotlin", "pyproject.toml": "python", "setup.py": "python", "requirements.txt": "python", "go.mod": "go", "Cargo.toml": "rust", "composer.json": "php"}
NO_COMPANY = ["example", "test", "demo", "sample", "app", "project", "com", "org", "github", "gitlab", "local"]


def project_metadata(files: DataFrame, commits: DataFrame | None = None) -> DataFrame:
    """One row: language (of most manifests, then the first by name), company, people, terms.

    files: path, text. commits: author_name, author_email. The company is the first label of the domain that most authors
    write from; public mail and generic names don't count. Terms are parts of the manifests' names.
    """
    name = F.element_at(F.split("path", "/"), -1)
    kinds = F.create_map(*[F.lit(x) for kv in MANIFESTS.items() for x in kv])
    languages = files.select(F.element_at(kinds, name).alias("language")).where("language is not null").groupBy("language").count()
    first = lambda df, col: df.orderBy(F.desc("count"), col).limit(1).select(col)
    named = files.where(name.isin(list(MANIFESTS))).select(F.explode(F.regexp_extract_all("text", F.lit(r"(?:\"name\"\s*:\s*\"|^name\s*=\s*\"|<artifactId>|^module\s+)([A-Za-z0-9@/_.-]+)".replace("^", "(?m:^)")), F.lit(1))).alias("n"))
    terms = named.select(F.explode(F.split(F.lower("n"), r"[^a-z0-9]+")).alias("t")).where(F.length("t") >= 3).where(~F.col("t").isin(NO_COMPANY)).agg(F.sort_array(F.collect_set("t")).alias("terms"))
    out = terms.join(first(languages, "language"), how="left")
    if commits is None:
        return out.select("language", F.lit(None).cast("string").alias("company"), F.array().cast("array<string>").alias("people"), "terms")
    label = F.regexp_extract(F.lower("author_email"), r"@(?:[a-z0-9-]+\.)*([a-z0-9-]+)\.[a-z]+$", 1)
    company = commits.select(label.alias("company")).where("company != ''").where(~F.col("company").isin([*NO_COMPANY, "gmail", "outlook", "hotmail", "icloud", "yahoo", "users", "noreply"])).groupBy("company").count()
    people = commits.agg(F.sort_array(F.collect_set("author_name")).alias("people"))
    return out.join(first(company, "company"), how="left").join(people, how="left").select("language", "company", "people", "terms")


def file_tree(spark: SparkSession, folder: str, limit: int | None = 50, max_bytes: int = 512 * 1024) -> DataFrame:
    """path, text of source files; generated and dot folders are left out, so are files beyond max_bytes.

    Spark's file sources pass over names that begin with a dot, so `.env` files are not listed either.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).where(F.col("length") <= max_bytes)
    inside = F.regexp_replace("path", f"^.*?{folder.rstrip('/').split('/')[-1]}/", "")
    folders = F.split(inside, "/")
    hidden = F.exists(F.slice(folders, F.lit(1), F.size(folders) - 1), lambda d: d.startswith(".") | d.isin(SKIPPED))
    wanted = F.col("path").rlike(rf"(?i)(\.({'|'.join(EXTENSIONS)})|/\.env[^/]*)$")
    out = files.where(~hidden & wanted).select("path", decode_with_bom(F.col("content")).alias("text"))
    return out.orderBy("path").limit(limit) if limit else out


LOG_SCHEMA = "timestamp long, layer string, type string, originalHash string, context string, seq long, sentinel boolean, prevHash string"


def audit_log(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """file, line, value (the raw line, which signatures need), entry, base (the raw line without its hash), malformed."""
    raw = spark.read.text(paths).select(F.col("_metadata.file_name").alias("file"), "value").where(F.trim("value") != "")
    entry = F.from_json("value", LOG_SCHEMA)
    base = F.regexp_replace("value", r',"prevHash":"[0-9a-f]*"', "")
    return raw.select("file", F.get_json_object("value", "$.seq").cast("long").alias("line"), "value", entry.alias("entry"), base.alias("base"), F.try_parse_json("value").isNull().alias("malformed"))
