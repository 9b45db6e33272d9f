"""File sources and sinks: packages, logs, decks, matrices, inventories and report tables."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from modalframe.operators.ordered import with_order

# The marks of the solver log and the input deck.
STEP_MARK = r"S T E P\s+(\d+)\s+C A L C U L A T I O N   O F   E I G E N V A L U E S"
TABLE_MARK = "E I G E N V A L U E    O U T P U T"
TABLE_ENDS = ("EIGENVALUES MARKED", "P A R T")
NAME_MARK, RECORD_END = "\x1d", "\x1e"
# The tasks move their files themselves; the driver would move many small files one by one.
BY_TASKS = {"mapreduce.fileoutputcommitter.algorithm.version": "2"}
CONSTANTS = ("E1", "E2", "E3", "nu12", "nu13", "nu23", "G12", "G13", "G23")

HISTORY = T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("region", T.StringType()), T.StructField("description", T.StringType()),
                                    T.StructField("data", T.ArrayType(T.ArrayType(T.DoubleType())))]))
MANIFEST = T.StructType([
    T.StructField("format_version", T.IntegerType()), T.StructField("geometry_file", T.StringType()), T.StructField("geometry_node_count", T.LongType()),
    T.StructField("step_name", T.StringType()), T.StructField("package_id", T.LongType()),
    T.StructField("modes", T.ArrayType(T.StructType([T.StructField("mode", T.LongType()), T.StructField("frequency_hz", T.DoubleType()), T.StructField("frame_index", T.LongType()),
                                                     T.StructField("description", T.StringType()), T.StructField("file", T.StringType()), T.StructField("node_count", T.LongType())]))),
    T.StructField("history", HISTORY)])
GEOMETRY = T.StructType([T.StructField("instance", T.StringType(), False), T.StructField("node_label", T.LongType(), False), *[T.StructField(c, T.DoubleType(), False) for c in "xyz"]])
MODE_FILE = T.StructType([T.StructField("instance", T.StringType(), False), T.StructField("node_label", T.LongType(), False),
                          *[T.StructField(f"u{d}_{p}", T.DoubleType(), False) for p in ("real", "imag") for d in (1, 2, 3)]])


# ------------------------------------------------------------------------------------------------ packages
def read_manifests(spark: SparkSession, path: str, one_per_file: bool = True) -> DataFrame:
    """One row per mode entry with its package fields; format 2 without a geometry file is marked refused."""
    m = spark.read.schema(MANIFEST).option("multiLine", one_per_file).option("recursiveFileLookup", True).json(path)
    m = m.withColumn("format_version", F.coalesce("format_version", F.lit(1)))
    m = m.withColumn("refused", (F.col("format_version") >= 2) & F.coalesce(F.col("geometry_file") == "", F.lit(True)))
    return m.select("package_id", "format_version", "geometry_file", "geometry_node_count", "step_name", "refused", F.explode_outer("modes").alias("m")).select(
        "*", F.col("m.mode").alias("mode_no"), F.col("m.frequency_hz").alias("frequency_hz"), F.col("m.description").alias("description"), F.col("m.file").alias("file"), F.col("m.node_count").alias("node_count")).drop("m")


def read_history(spark: SparkSession, path: str, one_per_file: bool = True) -> DataFrame:
    """History outputs of the manifests as (package, region, name, x, value) rows."""
    m = spark.read.schema(MANIFEST).option("multiLine", one_per_file).option("recursiveFileLookup", True).json(path)
    h = m.select("package_id", F.explode("history").alias("h")).select("package_id", "h.region", "h.name", "h.description", F.explode("h.data").alias("d"))
    return h.select("package_id", "region", "name", "description", F.get("d", F.lit(0)).alias("x"), F.get("d", F.lit(1)).alias("value"))


def read_geometry(spark: SparkSession, path: str) -> DataFrame:
    """Node geometry CSVs (schema enforced, malformed rows fail); dataset_id from the folder name."""
    g = spark.read.schema(GEOMETRY).option("header", True).option("mode", "FAILFAST").option("recursiveFileLookup", True).csv(path)
    return g.select(F.regexp_extract("_metadata.file_path", r"dataset_id=(\d+)", 1).cast("long").alias("dataset_id"), "instance", F.col("node_label").alias("node_id"), "x", "y", "z")


def read_mode_files(spark: SparkSession, path: str, geometry: DataFrame | None = None) -> DataFrame:
    """Per-mode displacement CSVs as shape rows. Format 2 takes its coordinates from ``geometry`` (missing nodes sit at the
    origin, as the reader of the files always did); format 1 carries x, y, z in the rows."""
    schema = MODE_FILE if geometry is not None else T.StructType([*MODE_FILE.fields[:2], *[T.StructField(c, T.DoubleType()) for c in "xyz"], *MODE_FILE.fields[2:]])
    m = spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").option("recursiveFileLookup", True).csv(path)
    file = F.col("_metadata.file_path")
    m = m.select(F.regexp_extract(file, r"dataset_id=(\d+)", 1).cast("long").alias("dataset_id"), F.regexp_extract(file, r"mode_no=(\d+)", 1).cast("long").alias("mode_no"), "*")
    if geometry is not None:
        m = m.join(geometry.select("dataset_id", "instance", F.col("node_id").alias("node_label"), "x", "y", "z"), ["dataset_id", "instance", "node_label"], "left")
        for c in "xyz":
            m = m.withColumn(c, F.coalesce(c, F.lit(0.0)))
    rows = ", ".join(f"{d}, u{d}_real, u{d}_imag" for d in (1, 2, 3))
    return m.selectExpr("dataset_id", "mode_no", "concat_ws(':', instance, node_label) AS node_id", "x", "y", "z", f"stack(3, {rows}) AS (dof, re, im)", "true AS measured")


# ------------------------------------------------------------------------------------------------ texts
def write_texts(texts: DataFrame, path: str) -> None:
    """Many small documents (name, value) in a few files: records ``GS name LF text RS``, which the readers below take apart."""
    texts.select(F.concat(F.lit(NAME_MARK), "name", F.lit("\n"), "value").alias("value")).write.mode("error").option("lineSep", RECORD_END).text(path)


def _whole(spark: SparkSession, path: str) -> DataFrame:
    """Every document below ``path``: a plain file is one, named by its path; a file of `write_texts` holds many named ones."""
    d = spark.read.option("recursiveFileLookup", True).option("lineSep", RECORD_END).text(path).select("value", F.col("_metadata.file_path").alias("file"))
    named = F.col("value").startswith(NAME_MARK)
    return d.select(F.when(named, F.regexp_replace("value", NAME_MARK + r"[^\n]*\n", "")).otherwise(F.col("value")).alias("value"),
                    F.when(named, F.regexp_extract("value", NAME_MARK + r"([^\n]*)\n", 1)).otherwise(F.col("file")).alias("file"))


def read_eigenvalue_tables(spark: SparkSession, path: str) -> DataFrame:
    """Every eigenvalue table of the solver logs: file, step, table_no, mode_no, eigenvalue, frequency_hz.

    A log is cut into its steps and those into tables by their marks; a table ends at its closing mark, so rows of other
    tables never leak in."""
    steps = _whole(spark, path).select("file", F.posexplode(F.split("value", r"(?=S T E P\s+\d+\s+C A L C U L A T I O N)")).alias("_s", "part"))
    steps = steps.withColumn("step", F.nullif(F.regexp_extract("part", STEP_MARK, 1), F.lit("")).cast("int"))
    tables = steps.select("file", "_s", "step", F.posexplode(F.split("part", TABLE_MARK)).alias("_t", "table")).filter("_t > 0")
    table_no = F.shiftleft(F.col("_s").cast("bigint"), 32) + F.col("_t")
    lines = tables.select("file", "step", table_no.alias("table_no"), F.posexplode(F.split("table", "\n")).alias("_n", "line"))
    closing = F.lit(False)
    for mark in TABLE_ENDS:
        closing = closing | F.trim("line").startswith(mark)
    t = lines.select("file", "step", "table_no", "_n", closing.alias("closing"), F.split(F.trim("line"), r"\s+").alias("cells"))
    ends = t.filter("closing").groupBy("file", "table_no").agg(F.min("_n").alias("_end"))
    t = t.join(ends, ["file", "table_no"], "left").filter(F.col("_end").isNull() | (F.col("_n") < F.col("_end")))
    cell = lambda k: F.get("cells", F.lit(k)).try_cast("double")
    mode = F.rtrim(F.get("cells", F.lit(0)), F.lit("*")).try_cast("bigint")
    rows = t.select("file", "step", "table_no", mode.alias("mode_no"), cell(1).alias("eigenvalue"), cell(2).alias("_w"), cell(3).alias("frequency_hz"), cell(4).alias("_m"))
    return rows.dropna(subset=["mode_no", "eigenvalue", "_w", "frequency_hz", "_m"]).drop("_w", "_m")


def read_material_decks(spark: SparkSession, path: str) -> DataFrame:
    """Engineering constants, density and shell thickness of each input deck as (file, name, value).

    A deck is a sequence of keyword blocks: a line that begins with one star, then data lines. Of repeated keywords the first
    block counts."""
    blocks = _whole(spark, path).select("file", F.posexplode(F.split("value", r"(?m)^\s*\*(?!\*)")).alias("_b", "block")).filter("_b > 0")
    head, body = F.lower(F.get(F.split("block", "\n"), F.lit(0))), F.split("block", "\n")
    keyword = F.trim(F.get(F.split(head, ","), F.lit(0)))
    data = F.filter(F.slice(body, F.lit(2), F.size(body)), lambda x: ~F.ltrim(x).startswith("*"))
    numbers = F.filter(F.transform(F.split(F.array_join(data, ","), r"[,\s]+"), lambda x: x.try_cast("double")), lambda x: x.isNotNull())
    known = keyword.isin("density", "shell section") | ((keyword == "elastic") & head.contains("engineering constants"))
    b = blocks.filter(known).select("file", "_b", keyword.alias("keyword"), numbers.alias("numbers"))
    b = b.groupBy("file", "keyword").agg(F.min_by("numbers", "_b").alias("numbers"))
    single = F.when(F.col("keyword") == "density", "rho").otherwise("h")
    names = F.when(F.col("keyword") == "elastic", F.array(*[F.lit(n) for n in CONSTANTS])).otherwise(F.array(single))
    return b.select("file", F.explode(F.zip_with(names, "numbers", lambda n, v: F.struct(n.alias("name"), v.alias("value")))).alias("c")).filter(
        "c.name is not null and c.value is not null").select("file", "c.name", "c.value")


def read_matrix_entries(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Coordinate files (node, dof, node, dof, value) as (both-triangle entries, problems).

    Values may use a D exponent; comments start with ``**``. Malformed or non-finite rows and repeated symmetric entries
    are reported; a matrix with any problem has no entries."""
    t = spark.read.option("recursiveFileLookup", True).text(path).select(F.regexp_extract("_metadata.file_path", r"matrix_id=(\d+)", 1).cast("long").alias("matrix_id"), F.trim("value").alias("line"))
    t = t.filter((F.col("line") != "") & ~F.col("line").startswith("**")).withColumn("p", F.split("line", r"\s*,\s*"))
    num = lambda k, kind: F.get("p", F.lit(k)).try_cast(kind)
    e = t.select("matrix_id", "line", F.size("p").alias("k"), num(0, "long").alias("n1"), num(1, "int").alias("d1"), num(2, "long").alias("n2"), num(3, "int").alias("d2"),
                 F.regexp_replace(F.get("p", F.lit(4)), "[dD]", "e").try_cast("double").alias("value"))
    good = (F.col("k") == 5) & (F.col("n1") > 0) & (F.col("d1") > 0) & (F.col("n2") > 0) & (F.col("d2") > 0) & F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < F.lit(float("inf")))
    good = F.coalesce(good, F.lit(False))
    bad = e.filter(~good).groupBy("matrix_id").agg(F.count(F.lit(1)).alias("n")).withColumn("problem", F.lit("malformed entry"))
    a, b = F.struct(F.col("n1").alias("node"), F.col("d1").alias("dof")), F.struct(F.col("n2").alias("node"), F.col("d2").alias("dof"))
    c = e.filter(good).select("matrix_id", F.least(a, b).alias("l"), F.greatest(a, b).alias("u"), "value")
    g = c.groupBy("matrix_id", "l", "u").agg(F.count(F.lit(1)).alias("k"), F.min("value").alias("value"))
    dup = g.filter("k > 1").groupBy("matrix_id").agg(F.count(F.lit(1)).alias("n")).withColumn("problem", F.lit("duplicate symmetric entry"))
    problems = bad.unionByName(dup)
    keep = g.filter("value <> 0").join(problems, "matrix_id", "left_anti")
    row = lambda x, y: keep.select("matrix_id", F.col(f"{x}.node").alias("i_node"), F.col(f"{x}.dof").alias("i_dof"), F.col(f"{y}.node").alias("j_node"), F.col(f"{y}.dof").alias("j_dof"), "value")
    return row("l", "u").unionByName(row("u", "l").filter("i_node <> j_node or i_dof <> j_dof")), problems


def file_inventory(spark: SparkSession, path: str) -> DataFrame:
    """SHA-256 and size of every file below ``path`` (package from the folder name)."""
    b = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return b.select(F.regexp_extract("path", r"package_id=(\d+)", 1).cast("long").alias("package_id"), F.regexp_extract("path", r"package_id=\d+/(.*)$", 1).alias("path"),
                    F.when(F.col("path").contains("geometry"), "geometry").otherwise("mode").alias("role"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def package_hashes(inventory: DataFrame) -> DataFrame:
    """One hash per package over its sorted file entries."""
    item = F.concat_ws("|", "role", "path", F.col("size").cast("string"), "sha256")
    return inventory.groupBy("package_id").agg(F.sha2(F.concat_ws("\n", F.sort_array(F.collect_list(item))), 256).alias("package_sha256"), F.count(F.lit(1)).alias("n_files"))


# ------------------------------------------------------------------------------------------------ sinks
def write_candidates(candidates: DataFrame, path: str) -> None:
    """The full candidate table as CSV (reasons joined by ;) and as JSON lines."""
    flat = candidates.withColumn("reasons", F.concat_ws(";", "reasons"))
    flat.write.mode("error").option("header", True).csv(f"{path}/csv")
    candidates.write.mode("error").json(f"{path}/json")


def write_tables(tables: dict[str, DataFrame], path: str, kind: str = "parquet", partition: str | None = None) -> None:
    """Named report tables below one folder."""
    for name, df in tables.items():
        w = df.write.mode("error")
        if partition and partition in df.columns:
            w = w.partitionBy(partition)
        (w.option("header", True).csv(f"{path}/{name}") if kind == "csv" else w.parquet(f"{path}/{name}"))


def mac_matrix(candidates: DataFrame) -> DataFrame:
    """The whole MAC matrix in long form: FE mode, ``position`` of the measured mode (by number within its comparison), MAC."""
    modes = candidates.select("cmp_id", "exp_mode").distinct()
    pos = with_order(modes, ["cmp_id"], F.floor(F.col("exp_mode") / 1024), ["exp_mode"], rank="position")
    return candidates.join(pos, ["cmp_id", "exp_mode"]).select("cmp_id", "fe_mode", "position", F.col("mac").alias("cell_mac"))
