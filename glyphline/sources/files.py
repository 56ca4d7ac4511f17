"""Files of lines, and dictionaries in plain text, through Spark's readers and writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_lines(spark: SparkSession, path: str, skip_empty: bool = True, strip: bool = True, limit: int | None = None) -> DataFrame:
    """value (string) and json (variant; null where the line is no JSON) of each line; ``limit`` counts lines before empty ones are skipped."""
    lines = spark.read.text(path)
    if limit is not None:
        lines = lines.limit(limit)
    if strip:
        lines = lines.withColumn("value", F.regexp_replace("value", r"(?U)\A\s+|\s+\z", ""))
    if skip_empty:
        lines = lines.where(F.length(F.regexp_replace("value", r"(?U)\s+", "")) > 0)
    return lines.withColumn("json", F.try_parse_json("value"))


def stream_lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of files as they come."""
    return spark.readStream.text(path)


def write_lines(df: DataFrame, path: str, mode: str = "error", flat: bool = True) -> None:
    """One row a line: a single string column as it is (line feeds dropped), anything else as JSON."""
    if len(df.columns) == 1 and df.schema[0].dataType.simpleString() == "string":
        c = F.col(f"`{df.columns[0]}`")
        out = df.select((F.replace(c, F.lit("\n"), F.lit("")) if flat else c).alias("value"))
    elif len(df.columns) == 1 and df.schema[0].dataType.simpleString() in ("int", "bigint", "double", "float"):
        out = df.select(F.col(f"`{df.columns[0]}`").cast("string").alias("value"))
    else:
        out = df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("value"))
    out.write.mode(mode).text(path)


def slice_rows(df: DataFrame, order: str, start: int = 0, end: int | None = None) -> DataFrame:
    """Rows ``start`` to ``end`` (exclusive) by ``order``: a sort with a limit and an offset, not a window over all rows."""
    out = df.orderBy(order).offset(start)
    return out if end is None else out.limit(max(0, end - start))


def read_table(spark: SparkSession, path: str, columns: str, sep: str = "\t") -> DataFrame:
    """A delimited dictionary with the given schema; words, weights, idf, frequencies, conversions and codes all are such."""
    return spark.read.schema(columns).option("sep", sep).option("quote", "").csv(path)


def read_words(spark: SparkSession, path: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """word, distinct."""
    words = spark.read.text(path).select(F.col("value").alias("word"))
    if extra:
        words = words.union(spark.createDataFrame([(w,) for w in extra], "word string"))
    return words.distinct()


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    """gram, freq from lines of JSON [text, count]."""
    pair = F.from_json("value", "array<string>")
    return spark.read.text(path).select(pair[0].alias("gram"), pair[1].cast("bigint").alias("freq"))


def read_outline(spark: SparkSession, path: str, levels: int = 5) -> DataFrame:
    """line, depth, value, l0..l4 of a file indented by tabs: each line with the names above it.

    A dictionary is one small file, read in one task in the order of its lines; its
    window is over that file, never over a corpus.
    """
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("line", "raw"))
    lines = lines.where(F.trim(F.translate("raw", "\t", " ")) != "").select("line", (F.length("raw") - F.length(F.expr("ltrim('\t', raw)"))).alias("depth"), F.expr("ltrim('\t', raw)").alias("value"))
    name = F.split("value", "\t")[0]
    out = lines
    for k in range(levels):
        # a name of a higher level ends those below it
        seen = F.last(F.when(F.col("depth") == k, F.struct(F.col("line").alias("at"), name.alias("name"))), True).over(Window.orderBy("line"))
        out = out.withColumn(f"_l{k}", seen)
    for k in range(levels):
        above = F.lit(True) if k == 0 else F.col(f"_l{k}.at") > F.col(f"_l{k - 1}.at")
        out = out.withColumn(f"l{k}", F.when((F.col("depth") >= k) & above, F.col(f"_l{k}.name")))
    return out.drop(*[f"_l{k}" for k in range(levels)])


def read_sections(spark: SparkSession, path: str, header: str = r"\A(.+):\z") -> DataFrame:
    """section, value of a file of headed parts (continents and their countries, places and their number ranges)."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("line", "value")).where(F.trim("value") != "")
    head = F.regexp_extract("value", header, 1)
    return lines.withColumn("section", F.last(F.when(head != "", head), True).over(Window.orderBy("line"))).where(head == "").select("line", "section", "value")


def read_changes(spark: SparkSession, path: str) -> DataFrame:
    """date, department, old and new place (arrays of full and short names) from lines ``date \\t department \\t old... => new...``."""
    sides = F.split("value", r"\s*=>\s*")
    left = F.split(sides[0], "\t")
    return spark.read.text(path).where(F.col("value").contains("=>")).select(
        left[0].alias("date"), left[1].alias("department"), F.slice(left, 3, 100).alias("old_loc"), F.split(sides[1], "\t").alias("new_loc")
    )


def expand_prefixes(ranges: DataFrame, prefix: str = "prefix", spans: str = "ranges") -> DataFrame:
    """Columns of ``ranges`` and code: each prefix with the four-digit numbers of its ranges ("0-3,17")."""
    one = F.explode(F.split(spans, ",")).alias("r")
    rows = ranges.select("*", one)
    lo, hi = F.split("r", "-")[0].cast("int"), F.coalesce(F.try_element_at(F.split("r", "-"), F.lit(2)).cast("int"), F.split("r", "-")[0].cast("int"))
    return rows.withColumn("n", F.explode(F.sequence(lo, hi))).withColumn("code", F.concat(F.col(prefix), F.lpad(F.col("n").cast("string"), 4, "0"))).drop("r", "n")


def exam_questions(spark: SparkSession, path: str) -> DataFrame:
    """question_type, question, correct_answer, score; the last two may be missing."""
    return spark.read.schema("question_type string, question string, correct_answer string, score double").json(path)


def read_zips(spark: SparkSession, path: str) -> DataFrame:
    """archive, name, line, value: the lines of every text file in zip archives, an archive a task."""
    import io
    import zipfile

    def run(frames):
        import pandas as pd

        for f in frames:
            for at, content in zip(f["path"], f["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for name in sorted(n for n in z.namelist() if not n.endswith("/")):
                        lines = z.read(name).decode("utf-8").split("\n")
                        lines = lines[:-1] if lines[-1] == "" else lines
                        yield pd.DataFrame({"archive": at, "name": name, "line": range(len(lines)), "value": lines})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "archive string, name string, line long, value string")


def write_zips(df: DataFrame, path: str, name: str = "name", order: str = "line", value: str = "value", mode: str = "error") -> None:
    """An archive ``name.zip`` below ``path`` for each name, with its lines in order; each must fit a task's memory, as dictionaries do."""
    import base64
    import io
    import zipfile

    def run(key, frame):
        import pandas as pd

        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr(zipfile.ZipInfo(key[0]), "".join(f"{v}\n" for v in frame.sort_values("line")["value"]))
        return pd.DataFrame({"name": [key[0]], "content": [base64.b64encode(out.getvalue()).decode()]})

    rows = df.select(F.col(name).alias("name"), F.col(order).cast("long").alias("line"), F.col(value).alias("value"))
    made = rows.groupBy("name").applyInPandas(run, "name string, content string")
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    store = at.getFileSystem(conf)
    if mode == "error" and store.exists(at):
        raise FileExistsError(path)
    for r in made.toLocalIterator():  # one archive at a time
        out = store.create(jvm.org.apache.hadoop.fs.Path(at, f"{r['name']}.zip"), True)
        out.write(base64.b64decode(r["content"]))
        out.close()
