"""Reading logs, ledgers, archives and report files; writing them back."""

from __future__ import annotations

import json
import re
import tomllib
import uuid
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import col, is_container

LEDGER = "ts string, cmd string, adapter string, tokens_in long, tokens_out long, saved long, exit int, run_id string, inner_cmd string"
META = "id string, ts string, argv array<string>, mode string, exit int, cwd string, stdout_bytes long, stderr_bytes long"
REPORT = "kind string, runner string, failed long, total long, items array<struct<id:string,loc:string,rule:string,msg:string>>, rendered string"


def texts(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, text, raw): one row per file; invalid UTF-8 is replaced in text."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    raw = F.col("content").cast("string")
    return files.select(F.col("path").alias("doc_id"), F.when(F.is_valid_utf8(raw), raw).otherwise(F.make_valid_utf8(raw)).alias("text"), F.when(~F.is_valid_utf8(raw), F.col("content")).alias("raw"))


def literal_run(spark: SparkSession, stdout: str, stderr: str = "", run_id: str = "ingest") -> DataFrame:
    """(run_id, stdout, stderr) of given texts, as if a command had printed them."""
    return spark.createDataFrame([(run_id, stdout, stderr)], "run_id string, stdout string, stderr string")


#: Words in a script that say it wraps a noisy tool; fixed.
NOISY_MARKERS = ("xcodebuild", "swift test", "swift build", "pytest", "cargo test", "cargo build")


def wrapper_scripts(spark: SparkSession, root: str) -> DataFrame:
    """(script): shell scripts right below ``root`` that call a noisy tool."""
    files = spark.read.option("pathGlobFilter", "*.sh").option("recursiveFileLookup", "false").text(root, wholetext=True)
    marked = F.exists(F.array(*map(F.lit, NOISY_MARKERS)), lambda m: F.contains("value", m))
    return files.where(marked).select(F.concat(F.lit("./"), F.col("_metadata.file_name")).alias("script"))


def permission_rules(settings: DataFrame) -> DataFrame:
    """(rule, unreadable): the shell rules that ask or deny, each once, in the order of
    the settings files (n, text); ``unreadable`` if any file is not of their form."""
    rules = F.from_json("text", "permissions struct<ask:array<string>,deny:array<string>>, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    kind = lambda path: F.schema_of_variant(F.try_variant_get(F.try_parse_json("text"), path, "variant"))
    fits = lambda path, form: F.coalesce(kind(path).startswith(form), F.lit(True))
    fine = F.try_parse_json("text").isNotNull() & kind("$").startswith("OBJECT") & fits("$.permissions", "OBJECT") & fits("$.permissions.ask", "ARRAY") & fits("$.permissions.deny", "ARRAY")
    rows = settings.withColumn("r", rules).withColumn("fine", F.coalesce(fine, F.lit(False)))
    listed = F.concat(F.coalesce("r.permissions.ask", F.array().cast("array<string>")), F.coalesce("r.permissions.deny", F.array().cast("array<string>")))
    one = rows.select("n", F.posexplode(listed).alias("k", "rule"), "fine").where("fine").withColumn("rule", F.trim("rule"))
    one = one.where((F.col("rule") == "Bash") | F.col("rule").startswith("Bash(") | F.col("rule").startswith("Bash "))
    first = one.groupBy("rule").agg(F.min(F.struct("n", "k")).alias("at"))
    bad = rows.agg(F.coalesce(F.max(~F.col("fine")), F.lit(False)).alias("unreadable")).withColumn("_k", F.lit(0))
    return bad.join(first.withColumn("_k", F.lit(0)), "_k", "left").orderBy("at").select("rule", "unreadable")


def _objects(line: str) -> tuple[list[str], bool]:
    """The JSON objects glued together on one line; whether the line is broken."""
    decoder, found, at = json.JSONDecoder(), [], 0
    while at < len(line.rstrip()):
        try:
            value, end = decoder.raw_decode(line, at + len(line[at:]) - len(line[at:].lstrip()))
        except ValueError:
            return found, True
        if not isinstance(value, dict) or not isinstance(value.get("tokens_in"), int) or not isinstance(value.get("cmd"), str):
            return found, True
        found.append(json.dumps(value))
        at = end
    return found, not found


def parse_ledger(lines: DataFrame) -> DataFrame:
    """Rows (seq, malformed, ledger fields) of JSON lines (seq, line).

    Lines that hold one object are read by expressions; glued ones by a decoder.
    A line with a broken rest gives what came before it and a malformed row.
    """
    rows = lines.where(F.trim("line") != "")
    parsed = rows.withColumn("r", F.from_json("line", LEDGER)).withColumn("whole", is_container("line") & F.col("r.tokens_in").isNotNull() & F.col("r.cmd").isNotNull())
    good = parsed.where("whole").select("seq", F.lit(0).alias("part"), F.lit(False).alias("malformed"), "r.*")

    @F.pandas_udf("objects array<string>, broken boolean")
    def split(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_objects(t) for t in texts], columns=["objects", "broken"])

    rest = parsed.where("not whole").select("seq", split("line").alias("s"))
    glued = rest.select("seq", F.posexplode("s.objects").alias("part", "o")).select("seq", "part", F.lit(False).alias("malformed"), F.from_json("o", LEDGER).alias("r")).select("seq", "part", "malformed", "r.*")
    broken = rest.where("s.broken").select("seq", F.lit(-1).alias("part"), F.lit(True).alias("malformed"))
    return good.unionByName(glued).unionByName(broken, allowMissingColumns=True)


def _listing(spark: SparkSession, path: str) -> list[str]:
    """Names of the files of a ledger, in the order in which they were written."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(where):
        return []
    found = [(x.getModificationTime(), x.getPath().getName()) for x in fs.listStatus(where) if x.isFile() and not x.getPath().getName().startswith(("_", "."))]
    return [name for _, name in sorted(found)]


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger at ``path``, the rotated one (``path.1``) before the live one;
    each a file or a folder of files. Other files beside them are not read.

    Files are read by lines and split as Spark likes; ``seq`` counts up by file,
    megabyte and line, not by one.
    """
    out = spark.createDataFrame([], "seq long, line string")
    for k, source in enumerate((path + ".1", path)):
        names = _listing(spark, source)
        if not names:
            continue
        files = F.broadcast(spark.createDataFrame(list(enumerate(names)), "f long, name string"))
        # numbers go up within a partition, so within each block of a file
        n = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
        rows = spark.read.text(source).select("value", F.col("_metadata.file_name").alias("name"), F.expr("_metadata.file_block_start div 1048576").alias("mb"), n.alias("n"))
        rows = rows.where("trim(value) <> ''").join(files, "name")
        seq = F.lit(k) * (1 << 61) + F.col("f") * (1 << 48) + F.col("mb") * (1 << 33) + F.col("n")
        out = out.unionByName(rows.select(seq.alias("seq"), F.col("value").alias("line")))
    return parse_ledger(out)


#: Bytes at which a ledger is rotated; fixed.
LEDGER_BYTES = 5 << 20


def append_ledger(rows: DataFrame, path: str, most: int = LEDGER_BYTES) -> None:
    """Append JSON lines; a ledger that is full first becomes ``path.1``, in place of the last one."""
    spark = rows.sparkSession
    jvm = spark._jvm.org.apache.hadoop.fs
    live, old = jvm.Path(path), jvm.Path(path + ".1")
    fs = live.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(live) and fs.getContentSummary(live).getLength() >= most:
        if fs.exists(old):
            fs.delete(old, True)
        fs.rename(live, old)
    rows.write.mode("append").json(path)


def archive(spark: SparkSession, root: str) -> DataFrame:
    """Runs of an archive (meta.json per run), newest first; corrupt ones are skipped."""
    metas = spark.read.schema(META + ", _corrupt string").option("multiLine", "true").option("columnNameOfCorruptRecord", "_corrupt").json(f"{root}/*/meta.json")
    rows = metas.select("*", F.col("_metadata.file_modification_time").alias("mtime")).where("_corrupt is null and id is not null").drop("_corrupt")
    return rows.where(F.col("id").rlike("^[A-Za-z0-9-]+$")).orderBy(F.desc("id"))


def run_lines(spark: SparkSession, root: str) -> DataFrame:
    """(doc_id, stream, text): the raw logs of every run; an empty log has no row."""
    files = spark.read.text([f"{root}/*/stdout.log", f"{root}/*/stderr.log"], wholetext=True).withColumn("f", F.input_file_name())
    return files.select(F.regexp_extract("f", "/([^/]+)/[^/]+$", 1).alias("doc_id"), F.regexp_extract("f", r"/(\w+)\.log$", 1).alias("stream"), F.col("value").alias("text"))


def load_run(spark: SparkSession, root: str, run_id: str) -> DataFrame:
    """(id, ..., stdout, stderr) of one run; an id may only hold letters, digits and hyphens."""
    if not re.fullmatch("[A-Za-z0-9-]+", run_id):
        raise ValueError(f"invalid run id {run_id!r}")
    meta = spark.read.schema(META).option("multiLine", "true").json(f"{root}/{run_id}/meta.json")
    files = spark.read.option("pathGlobFilter", "std*.log").text(f"{root}/{run_id}", wholetext=True).select(F.col("_metadata.file_name").alias("f"), "value")
    both = files.agg(*(F.coalesce(F.max(F.when(F.col("f") == f"{s}.log", F.col("value"))), F.lit("")).alias(s) for s in ("stdout", "stderr")))
    return meta.withColumn("k", F.lit(0)).join(both.withColumn("k", F.lit(0)), "k").drop("k")  # a row each


def reports(spark: SparkSession, root: str) -> DataFrame:
    rows = spark.read.schema(REPORT).option("multiLine", "true").json(f"{root}/*/report.json")
    return rows.withColumn("run_id", F.regexp_extract(F.col("_metadata.file_path"), "/([^/]+)/[^/]+$", 1))


def write_archive(runs: DataFrame, root: str) -> None:
    """Runs (the fields of ``META`` but for sizes, and stdout, stderr) as a folder
    each: meta.json and both logs, which :func:`archive`, :func:`run_lines` and
    :func:`load_run` read."""
    sizes = [F.octet_length(F.coalesce(s, F.lit(""))).cast("long").alias(f"{s}_bytes") for s in ("stdout", "stderr")]
    names = [x.split()[0] for x in META.split(", ")]
    file = lambda name, value: F.struct(F.lit(name).alias("file"), value.alias("value"))
    meta = F.concat(F.to_json(F.struct(*names)), F.lit("\n"))
    files = F.array(file("meta.json", meta), *(file(f"{s}.log", F.coalesce(s, F.lit(""))) for s in ("stdout", "stderr")))
    _write_files(runs.select("*", *sizes).select(F.col("id").alias("run"), F.inline(files)), root)


def write_reports(reports: DataFrame, root: str) -> None:
    """Stored reports (run_id, and the fields of ``REPORT``) as report.json of their runs."""
    fields = [c for c in reports.columns if c != "run_id"]
    _write_files(reports.select(F.col("run_id").alias("run"), F.lit("report.json").alias("file"), F.concat(F.to_json(F.struct(*fields)), F.lit("\n")).alias("value")), root)


def _write_files(rows: DataFrame, root: str) -> None:
    """(run, file, value): each value as the file root/run/file.

    Spark writes every file as the only record of a partition, and the driver
    renames it; it copies only texts without a last line end, which Spark adds.
    Runs whose ids hold other than letters, digits and hyphens are left out.
    """
    spark = rows.sparkSession
    jvm = spark._jvm.org.apache.hadoop.fs
    stage = f"{root.rstrip('/')}/_new-{uuid.uuid4().hex}"
    ended = F.col("value").endswith("\n")
    rows = rows.where(F.col("run").rlike("^[A-Za-z0-9-]+$")).select("run", "file", ended.alias("ended"), F.when(ended, F.expr("left(value, length(value) - 1)")).otherwise(F.col("value")).alias("value"))
    rows.write.partitionBy("run", "file", "ended").text(stage)
    fs = jvm.Path(stage).getFileSystem(spark._jsc.hadoopConfiguration())
    for status in fs.globStatus(jvm.Path(f"{stage}/run=*/file=*/ended=*/part-*")) or []:
        part = status.getPath()
        run, file, whole = (p.getName().split("=", 1)[1] for p in (part.getParent().getParent().getParent(), part.getParent().getParent(), part.getParent()))
        target = jvm.Path(f"{root}/{run}/{file}")
        fs.mkdirs(target.getParent())
        if whole == "true":
            fs.delete(target, False)
            fs.rename(part, target)
        else:
            data, out = fs.open(part), fs.create(target, True)
            spark._jvm.org.apache.commons.io.IOUtils.copyLarge(data, out, 0, status.getLen() - 1)
            out.close()
            data.close()
    fs.delete(jvm.Path(stage), True)


def report_files(spark: SparkSession, root: str, pattern: str = "*.xml", since: Column | None = None, slack: int = 2, depth: int | None = None) -> DataFrame:
    """(path, text, modificationTime, length) of report files below ``root``.

    ``since``: only files written from then on, less ``slack`` seconds.
    ``depth``: at most so many folders below ``root``.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    if since is not None:
        files = files.where(F.col("modificationTime") >= since - F.expr(f"interval {slack} seconds"))
    if depth is not None:
        files = files.where(F.size(F.split(below("path", root), "/")) <= depth + 1)
    return files.select("path", F.col("content").cast("string").alias("text"), "modificationTime", "length").orderBy("path")


def below(path: str | Column, root: str) -> Column:
    """What of ``path`` follows the folder ``root``."""
    folder = re.sub("^[a-z]+:/*", "/", root).rstrip("/")
    return F.regexp_replace(col(path), "^(?:[a-z]+:)?/*\\Q" + folder + "\\E/", "")


#: Where JVM build tools leave reports: a folder, and folders in it; how deep modules and reports may lie.
JVM_REPORTS = {"gradle": ("build", ("test-results",)), "maven": ("target", ("surefire-reports", "failsafe-reports"))}
MODULE_DEPTH, REPORT_DEPTH = 6, 4


def jvm_reports(spark: SparkSession, root: str, tool: str, since: Column | None = None) -> DataFrame:
    """Report files (path, module, text, ...) of all modules of a gradle or maven project.

    A module is a folder with a build folder; hidden folders, dependencies and
    sources hold none, and what a build wrote holds no module.
    """
    anchor, subs = JVM_REPORTS[tool]
    files = report_files(spark, root, "TEST-*.xml", since).withColumn("at", below("path", root))
    form = rf"^((?:[^/]+/)*?){anchor}/(?:{'|'.join(subs)})/((?:[^/]+/)*)[^/]+$"
    module = F.regexp_extract("at", form, 1)
    folders = F.filter(F.split(module, "/"), lambda x: x != "")
    bad = F.exists(folders, lambda x: x.startswith(".") | x.isin("node_modules", "src", anchor))
    deep = F.size(F.filter(F.split(F.regexp_extract("at", form, 2), "/"), lambda x: x != ""))
    kept = files.where(F.col("at").rlike(form) & ~bad & (F.size(folders) < MODULE_DEPTH) & (deep <= REPORT_DEPTH))
    return kept.withColumn("module", module).drop("at")


def written_since(before: DataFrame, after: DataFrame) -> DataFrame:
    """Files of ``after`` that ``before`` did not have with that time and length."""
    return after.join(before, ["path", "modificationTime", "length"], "left_anti")


@dataclass
class Config:
    tokenizer: str = "approx"
    trace_lines: int = 20
    keep_runs: int = 50
    max_archive_mb: int = 50
    max_tokens: int | None = None
    level: str | None = None
    merge_streams: bool = False
    commands: dict = field(default_factory=dict)
    wrap_scripts: list = field(default_factory=list)

    def level_of(self, head: str, flag: str | None = None) -> str:
        """Flag, then the command's own, then scripts, then the general level, then safe."""
        own = self.commands.get(head, {}).get("level")
        return flag or own or ("aggressive" if head in self.wrap_scripts else None) or self.level or "safe"

    def merges(self, head: str, flag: bool | None = None) -> bool:
        own = self.commands.get(head, {}).get("merge_streams")
        return next(x for x in (flag, own, self.merge_streams) if x is not None)


def load_config(*toml_texts: str) -> Config:
    """Later texts win; the commands of all are kept."""
    out = Config()
    for text in toml_texts:
        data = tomllib.loads(text)
        compress = data.pop("compress", {})
        for key, value in {**data, **compress}.items():
            if key == "command":
                out.commands = {**out.commands, **value}
            elif hasattr(out, key):
                setattr(out, key, value)
    return out
