"""Queries on names, sources and the shapes of tables."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import functions as F

from peakweave.functions import names
from peakweave.operators import metals, naming, reshape
from peakweave.operators.summary import join_in_chunks, label_pairs, parameter_grid, union_names
from peakweave.queries.registry import CELLS_SQL, LABELS_SQL, PEAKS_SQL, POSITIONED_SQL, cells, labelled_files, peaks, positioned, query, table
from peakweave.session import shared_dir
from peakweave.sources import files

# A file name is built from each line: site, product, replicate, day and batch follow from its keys.
_NAME_SQL = """named AS (
  SELECT l_orderkey AS scan, l_linenumber AS line,
    concat('LAB_GC_2023_',
      CASE WHEN l_suppkey % 2 = 0 THEN 'USE-' ELSE 'USSB-' END, lpad(CAST(l_suppkey % 16 AS VARCHAR), 2, '0'), '_',
      CASE l_partkey % 9 WHEN 0 THEN 'Balloons' WHEN 1 THEN 'FPW_' WHEN 2 THEN 'MPW_' WHEN 3 THEN 'PBBC_' WHEN 4 THEN 'PC_Sample'
        WHEN 5 THEN 'PDS_Sample' WHEN 6 THEN 'Cigs_' WHEN 7 THEN 'Mask_Sample' ELSE 'Blank' END,
      '_R', CAST(l_linenumber AS VARCHAR), '_Day', CASE l_suppkey % 4 WHEN 0 THEN '0' WHEN 1 THEN '2' WHEN 2 THEN '15' ELSE '34' END, '.csv') AS file
  FROM lineitem)"""


def _named(spark, sf):
    line = table(spark, sf, "lineitem")
    pick = F.col("l_partkey") % 9
    product = F.lit("Blank")
    for i, text in enumerate(("Balloons", "FPW_", "MPW_", "PBBC_", "PC_Sample", "PDS_Sample", "Cigs_", "Mask_Sample")):
        product = F.when(pick == i, text).otherwise(product)
    day = F.col("l_suppkey") % 4
    return line.select(
        F.col("l_orderkey").alias("scan"),
        F.col("l_linenumber").alias("line"),
        F.concat(
            F.lit("LAB_GC_2023_"),
            F.when(F.col("l_suppkey") % 2 == 0, "USE-").otherwise("USSB-"),
            F.lpad((F.col("l_suppkey") % 16).cast("string"), 2, "0"),
            F.lit("_"), product, F.lit("_R"), F.col("l_linenumber").cast("string"), F.lit("_Day"),
            F.when(day == 0, "0").when(day == 1, "2").when(day == 2, "15").otherwise("34"), F.lit(".csv"),
        ).alias("file"),
    )


def _case(rules, default, col="file"):
    whens = " ".join(f"WHEN contains({col}, '{p}') THEN '{label}'" for p, label in rules)
    return f"CASE {whens} ELSE '{default}' END"


@query(
    "classify_by_name",
    f"""WITH {_NAME_SQL} SELECT scan, line, {_case(names.PRODUCT_RULES, names.PRODUCT_DEFAULT)} AS product,
{_case(names.SHORT_PRODUCT_RULES, names.PRODUCT_DEFAULT)} AS short_product,
{_case(names.SITE_PRODUCT_RULES, names.PRODUCT_DEFAULT)} AS site_product,
{_case([(c, c) for c in names.SITE_CODES], names.SITE_DEFAULT)} AS site,
{_case(names.PLASTIC_TYPE_RULES, names.PLASTIC_TYPE_DEFAULT)} AS plastic_type,
{_case(names.PLASTIC_CODE_RULES, names.PLASTIC_CODE_DEFAULT)} AS plastic_code,
{_case(names.METAL_CATEGORY_RULES, names.METAL_CATEGORY_DEFAULT)} AS metal_category,
{_case(names.SOURCE_RULES, names.SOURCE_DEFAULT)} AS source,
{_case(names.DAY_RULES, names.DAY_DEFAULT)} AS day FROM named""",
)
def _classify(spark, sf):
    by = names.classify_by_name
    return _named(spark, sf).select(
        "scan", "line",
        by("file", names.PRODUCT_RULES, names.PRODUCT_DEFAULT).alias("product"),
        by("file", names.SHORT_PRODUCT_RULES, names.PRODUCT_DEFAULT).alias("short_product"),
        by("file", names.SITE_PRODUCT_RULES, names.PRODUCT_DEFAULT).alias("site_product"),
        by("file", [(c, c) for c in names.SITE_CODES], names.SITE_DEFAULT).alias("site"),
        by("file", names.PLASTIC_TYPE_RULES, names.PLASTIC_TYPE_DEFAULT).alias("plastic_type"),
        by("file", names.PLASTIC_CODE_RULES, names.PLASTIC_CODE_DEFAULT).alias("plastic_code"),
        by("file", names.METAL_CATEGORY_RULES, names.METAL_CATEGORY_DEFAULT).alias("metal_category"),
        by("file", names.SOURCE_RULES, names.SOURCE_DEFAULT).alias("source"),
        by("file", names.DAY_RULES, names.DAY_DEFAULT).alias("day"),
    )


_POLYMER_TEXT = "concat(p_name, '-', CASE p_partkey % 5 WHEN 0 THEN 'hdpe1' WHEN 1 THEN 'Pa66' WHEN 2 THEN 'lldpe2' WHEN 3 THEN 'Pvc1' ELSE 'x' END)"


@query(
    "classify_regex_ci",
    f"""WITH t AS (SELECT p_partkey, upper({_POLYMER_TEXT}) AS s FROM part)
SELECT p_partkey, {_case([(n, n) for n in names.POLYMERS], names.POLYMER_DEFAULT, 's')} AS polymer,
{_case([(n, n) for n in sorted(names.POLYMERS, key=len, reverse=True)], names.POLYMER_DEFAULT, 's')} AS longest FROM t""",
)
def _polymer(spark, sf):
    pick = F.col("p_partkey") % 5
    tail = F.when(pick == 0, "hdpe1").when(pick == 1, "Pa66").when(pick == 2, "lldpe2").when(pick == 3, "Pvc1").otherwise("x")
    text = F.concat("p_name", F.lit("-"), tail)
    return table(spark, sf, "part").select(
        "p_partkey", names.classify_regex_ci(text).alias("polymer"), names.classify_regex_ci(text, True).alias("longest")
    )


@query(
    "parse_file_name",
    f"""WITH {_NAME_SQL}, g AS (SELECT scan, line, replace(replace(file, '_', '-'), '.csv', '') AS file FROM named)
SELECT scan, line, file, CASE WHEN contains(file, 'R1') THEN 'R1' WHEN contains(file, 'R2') THEN 'R2' ELSE 'R3' END AS replicate,
array_to_string(list_slice(string_split(file, '-'), 4, 5), '-') AS simplified_file FROM g""",
)
def _parse(spark, sf):
    return names.parse_file_name(_named(spark, sf))


@query(
    "parse_file_name_lc",
    f"""WITH {_NAME_SQL}, g AS (SELECT scan, line, replace(file, '_', '-') AS file FROM named)
SELECT scan, line, file, array_to_string(list_slice(string_split(file, '-'), 2, 3), '-') AS simplified_file,
CASE WHEN contains(file, 'Blank') THEN 'Blanks' ELSE 'Sample' END AS type, '1' AS batch,
CASE WHEN contains(file, 'R1') THEN 'R1' ELSE 'R2' END AS replicate, {_case(names.DAY_RULES, names.DAY_DEFAULT)} AS day FROM g""",
)
def _parse_lc(spark, sf):
    return names.parse_file_name(_named(spark, sf), kind="1")


@query(
    "filter_files",
    f"""WITH {_NAME_SQL} SELECT scan, line, file FROM named WHERE regexp_matches(file, 'R1|R2') AND NOT regexp_matches(file, 'Blank|USE-03')""",
)
def _filter_files(spark, sf):
    return files.filter_files(_named(spark, sf), include=["R1", "R2"], exclude=["Blank", "USE-03"])


_METAL_SQL = """metal AS (
  SELECT p_partkey, concat(CAST(20 + p_size AS VARCHAR), CASE WHEN p_partkey % 2 = 0 THEN concat(' -> ', CAST(36 + p_size AS VARCHAR)) ELSE '' END, ' ',
    CASE p_partkey % 6 WHEN 0 THEN 'Na' WHEN 1 THEN 'Fe' WHEN 2 THEN 'Cu' WHEN 3 THEN 'Ca' WHEN 4 THEN 'Zn' ELSE 'Cd' END, ' ',
    CASE p_partkey % 5 WHEN 0 THEN '[ H2 HMI ]' WHEN 1 THEN '[ H2 ]' WHEN 2 THEN '[ N2O ]' WHEN 3 THEN '[ No gas ]' ELSE '' END) AS name,
    CASE WHEN p_partkey % 7 < 3 THEN NULL ELSE p_retailprice END AS recovery, CAST(p_size AS DOUBLE) AS uncertainty
  FROM part)"""


def _metals(spark, sf):
    k = F.col("p_partkey")
    element = F.when(k % 6 == 0, "Na").when(k % 6 == 1, "Fe").when(k % 6 == 2, "Cu").when(k % 6 == 3, "Ca").when(k % 6 == 4, "Zn").otherwise("Cd")
    mode = F.when(k % 5 == 0, "[ H2 HMI ]").when(k % 5 == 1, "[ H2 ]").when(k % 5 == 2, "[ N2O ]").when(k % 5 == 3, "[ No gas ]").otherwise("")
    shift = F.when(k % 2 == 0, F.concat(F.lit(" -> "), (F.col("p_size") + 36).cast("string"))).otherwise("")
    return table(spark, sf, "part").select(
        "p_partkey",
        F.concat((F.col("p_size") + 20).cast("string"), shift, F.lit(" "), element, F.lit(" "), mode).alias("name"),
        F.when(k % 7 < 3, F.lit(None)).otherwise(F.col("p_retailprice")).alias("recovery"),
        F.col("p_size").cast("double").alias("uncertainty"),
    )


@query(
    "clean_metal_name",
    f"""WITH {_METAL_SQL} SELECT p_partkey, name,
regexp_replace(trim(regexp_extract(name, '^[^\\[]+')), '\\d+ *(-> *\\d+)? *', '', 'g') AS element FROM metal""",
)
def _clean(spark, sf):
    return _metals(spark, sf).select("p_partkey", "name", names.clean_metal_name("name").alias("element"))


@query(
    "drop_gas_mode",
    f"""WITH {_METAL_SQL} SELECT p_partkey, name FROM metal WHERE name LIKE '%[ % ]' AND NOT contains(name, 'H2 HMI')""",
)
def _gas(spark, sf):
    return names.drop_gas_mode(_metals(spark, sf), "name").select("p_partkey", "name")


@query(
    "drop_elements_by_pattern",
    f"""WITH {_METAL_SQL} SELECT p_partkey, name FROM metal WHERE NOT (contains(name, 'Na') OR contains(name, 'Mg') OR contains(name, 'K') OR contains(name, 'Ca'))""",
)
def _elements(spark, sf):
    return names.drop_elements_by_pattern(_metals(spark, sf), "name").select("p_partkey", "name")


@query(
    "best_metal_mode",
    f"""WITH {_METAL_SQL}, o AS (SELECT *, string_split(name, ' ')[1] AS isotope FROM metal)
SELECT isotope, name, recovery, uncertainty FROM (SELECT *, row_number() OVER (PARTITION BY isotope
  ORDER BY recovery DESC NULLS LAST, uncertainty ASC NULLS LAST, name) AS rn FROM o) WHERE rn = 1""",
)
def _best(spark, sf):
    return metals.best_metal_mode(_metals(spark, sf).drop("p_partkey"))


@query(
    "metal_fingerprint",
    f"""WITH {_METAL_SQL}, o AS (SELECT *, string_split(name, ' ')[1] AS isotope FROM metal),
best AS (SELECT name FROM (SELECT *, row_number() OVER (PARTITION BY isotope ORDER BY recovery DESC NULLS LAST, uncertainty ASC NULLS LAST, name) AS rn FROM o) WHERE rn = 1),
long AS (SELECT l_suppkey AS file, m.name AS feature, l_suppkey % 3 AS batch, avg(round(l_extendedprice * 100)) AS value
  FROM lineitem JOIN metal m ON l_partkey = p_partkey GROUP BY ALL),
k AS (SELECT * FROM long WHERE feature IN (SELECT name FROM best)),
c AS (SELECT feature FROM k GROUP BY feature HAVING count(DISTINCT batch) = (SELECT count(DISTINCT batch) FROM k))
SELECT file, feature, value, 'ICP' AS technique FROM k WHERE feature IN (SELECT feature FROM c)
AND NOT regexp_matches(feature, 'Na|Mg|K|Ca')""",
)
def _metal_fingerprint(spark, sf):
    qc = _metals(spark, sf)
    long = peaks(spark, sf).join(qc.select(F.col("p_partkey").alias("feature"), "name"), "feature").groupBy("file", "name", "batch").agg(
        F.avg("value").alias("value")
    )
    out = metals.metal_fingerprint(long.withColumnRenamed("name", "feature"), qc.drop("p_partkey"))
    return out.select("file", "feature", "value", "technique")


@query(
    "replicate_suffix",
    f"""WITH {LABELS_SQL}, n AS (SELECT file, subcategory, count(*) OVER (PARTITION BY subcategory) AS c,
row_number() OVER (PARTITION BY subcategory ORDER BY file) AS rn FROM labelled_files)
SELECT file, CASE WHEN c > 1 THEN concat(subcategory, '_rep', CAST(rn AS VARCHAR)) ELSE subcategory END AS name FROM n""",
)
def _suffix(spark, sf):
    out = naming.replicate_suffix(labelled_files(spark, sf), "subcategory", ["file"], F.floor(F.col("file") / 16).cast("int"), "name")
    return out.select("file", "name")


@query(
    "strip_replicate_suffix",
    f"""WITH {LABELS_SQL}, n AS (SELECT file, concat(subcategory, '.x_rep', CAST(1 + file % 7 AS VARCHAR)) AS name FROM labelled_files)
SELECT file, regexp_replace(name, '_rep[1-5]', '') AS stripped, replace(regexp_replace(name, '_rep[1-5]', ''), '.', ' ') AS spaced,
CASE WHEN regexp_matches(regexp_replace(concat(CAST(file AS VARCHAR), ' ', name), '[^A-Za-z0-9._]', '.', 'g'), '^[0-9_]')
  THEN concat('X', regexp_replace(concat(CAST(file AS VARCHAR), ' ', name), '[^A-Za-z0-9._]', '.', 'g'))
  ELSE regexp_replace(concat(CAST(file AS VARCHAR), ' ', name), '[^A-Za-z0-9._]', '.', 'g') END AS identifier FROM n""",
)
def _strip(spark, sf):
    name = F.concat("subcategory", F.lit(".x_rep"), (1 + F.col("file") % 7).cast("string"))
    return labelled_files(spark, sf).select(
        "file",
        names.strip_replicate_suffix(name).alias("stripped"),
        names.dots_to_spaces(names.strip_replicate_suffix(name)).alias("spaced"),
        names.identifier(F.concat(F.col("file").cast("string"), F.lit(" "), name)).alias("identifier"),
    )


@query(
    "feature_label",
    f"""WITH {POSITIONED_SQL}, c AS (SELECT feature, CAST(round(avg(mz), 0) AS BIGINT) AS m, CAST(round(avg(rt), 0) AS BIGINT) AS t FROM positioned GROUP BY feature)
SELECT feature, concat(CAST(feature AS VARCHAR), '_m/z: ', CAST(m AS VARCHAR), '_RT: ', CAST(t AS VARCHAR)) AS label FROM c""",
)
def _label(spark, sf):
    c = positioned(spark, sf).groupBy("feature").agg(F.round(F.avg("mz"), 0).cast("long").alias("m"), F.round(F.avg("rt"), 0).cast("long").alias("t"))
    return c.select("feature", names.feature_label(F.col("feature"), F.col("m"), F.col("t")).alias("label"))


@query(
    "file_class_label",
    f"""WITH {LABELS_SQL} SELECT file, concat(CAST(file AS VARCHAR), '_', subcategory) AS label FROM labelled_files""",
)
def _file_label(spark, sf):
    return labelled_files(spark, sf).select("file", names.file_class_label(F.col("file"), F.col("subcategory")).alias("label"))


@query(
    "excel_serial_to_date",
    """SELECT l_orderkey AS scan, l_linenumber AS line,
CASE WHEN l_linenumber = 3 THEN NULL ELSE DATE '1899-12-30' + CAST(40000 + l_partkey AS INTEGER) END AS day FROM lineitem""",
)
def _excel(spark, sf):
    serial = F.when(F.col("l_linenumber") == 3, F.concat(F.lit("n/a "), F.col("l_partkey"))).otherwise((F.col("l_partkey") + 40000).cast("string"))
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("scan"), F.col("l_linenumber").alias("line"), names.excel_serial_to_date(serial).alias("day")
    )


@query(
    "drop_legacy_rows",
    """SELECT s_suppkey, name, bal FROM (SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE s_name END AS name,
CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE s_acctbal END AS bal FROM supplier) WHERE name IS NOT NULL OR bal IS NOT NULL""",
)
def _legacy(spark, sf):
    t = table(spark, sf, "supplier").select(
        "s_suppkey",
        F.when(F.col("s_suppkey") % 4 != 0, F.col("s_name")).alias("name"),
        F.when(F.col("s_suppkey") % 3 != 0, F.col("s_acctbal")).alias("bal"),
    )
    return files.drop_legacy_rows(t)


@query(
    "factor_codes",
    """SELECT o_orderkey, CAST(dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS INTEGER) AS code FROM orders""",
)
def _codes(spark, sf):
    return naming.factor_codes(table(spark, sf, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority").select("o_orderkey", "code")


# shapes ----------------------------------------------------------------------------------------------------------

@query(
    "to_matrix",
    f"""WITH {CELLS_SQL} SELECT feature, avg(value) FILTER (plastic_type = 'AFRICA') AS "AFRICA", avg(value) FILTER (plastic_type = 'AMERICA') AS "AMERICA",
avg(value) FILTER (plastic_type = 'ASIA') AS "ASIA", avg(value) FILTER (plastic_type = 'EUROPE') AS "EUROPE",
avg(value) FILTER (plastic_type = 'MIDDLE EAST') AS "MIDDLE EAST" FROM cells GROUP BY feature""".replace("avg(value) FILTER", "round(avg(value) FILTER").replace(") AS \"", "), 4) AS \""),
)
def _matrix(spark, sf):
    from peakweave.queries.registry import rounded

    classes = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
    return rounded(reshape.to_matrix(cells(spark, sf), ["feature"], "plastic_type", "value", classes), *classes, digits=4)


@query(
    "to_long",
    """SELECT l_orderkey AS scan, l_linenumber AS line, u.feature, u.value FROM lineitem,
LATERAL (VALUES ('l_quantity', l_quantity), ('l_extendedprice', l_extendedprice), ('l_discount', l_discount), ('l_tax', l_tax)) u(feature, value)""",
)
def _long(spark, sf):
    wide = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("scan"), F.col("l_linenumber").alias("line"), "l_quantity", "l_extendedprice", "l_discount", "l_tax"
    )
    return reshape.to_long(wide, ["scan", "line"])


@query("transpose", f"WITH {CELLS_SQL} SELECT feature AS file, file AS feature, value FROM cells")
def _transpose(spark, sf):
    return reshape.transpose(cells(spark, sf).select("file", "feature", "value"))


@query(
    "group_replicate_columns",
    """WITH cols AS (SELECT DISTINCT vec_id AS position, label AS name FROM embeddings),
rep AS (SELECT *, count(*) OVER (PARTITION BY name) AS c, row_number() OVER (PARTITION BY name ORDER BY position) AS rn FROM cols),
long AS (SELECT vec_id AS position, unnest(range(len(embedding))) AS wavenumber, CAST(unnest(embedding) AS DOUBLE) AS value FROM embeddings)
SELECT wavenumber, concat(CAST(name AS VARCHAR), '_rep', CAST(rn AS VARCHAR)) AS sample, value FROM long JOIN rep USING (position) WHERE c > 1""",
)
def _replicates(spark, sf):
    long = table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("position"), F.col("label").cast("string").alias("name"), F.posexplode("embedding").alias("wavenumber", "v")
    ).withColumn("value", F.col("v").cast("double")).drop("v")
    return naming.group_replicate_columns(long, ["wavenumber"], "name", "position")


# small tables ----------------------------------------------------------------------------------------------------

@query("label_pairs", f"WITH {LABELS_SQL}, n AS (SELECT DISTINCT subcategory AS s FROM labelled_files) SELECT a.s AS label_a, b.s AS label_b FROM n a JOIN n b ON a.s < b.s")
def _pairs(spark, sf):
    return label_pairs(labelled_files(spark, sf), "subcategory")


@query(
    "parameter_grid_counts",
    f"""WITH {PEAKS_SQL}, g AS (SELECT * FROM (VALUES (1000000), (5000000)) a(low), (VALUES (7000000), (9000000)) b(high))
SELECT low, high, count(*) AS n FROM peaks JOIN g ON value BETWEEN low AND high GROUP BY ALL""",
)
def _grid(spark, sf):
    grid = parameter_grid(spark, low=[1_000_000, 5_000_000], high=[7_000_000, 9_000_000])
    data = peaks(spark, sf)
    return data.join(F.broadcast(grid), F.col("value").between(F.col("low"), F.col("high"))).groupBy("low", "high").agg(F.count(F.lit(1)).alias("n"))


@query(
    "union_names",
    f"WITH {PEAKS_SQL} SELECT feature FROM peaks WHERE batch = 0 UNION SELECT feature FROM peaks WHERE value > 9000000",
)
def _union_names(spark, sf):
    data = peaks(spark, sf)
    return union_names(data.filter(F.col("batch") == 0), data.filter(F.col("value") > 9_000_000))


@query(
    "union_all_tagged",
    f"""WITH {PEAKS_SQL}, {LABELS_SQL} SELECT file, feature, value, 'Blanks' AS product_cat FROM peaks WHERE type = 'Blanks'
UNION ALL SELECT p.file, feature, value, plastic_type FROM peaks p JOIN labelled_files l ON p.file = l.file WHERE type = 'Sample'""",
)
def _union(spark, sf):
    data = peaks(spark, sf)
    blank = data.filter(F.col("type") == "Blanks").select("file", "feature", "value", F.lit("Blanks").alias("product_cat"))
    sample = data.filter(F.col("type") == "Sample").join(labelled_files(spark, sf), "file")
    return blank.unionByName(sample.select("file", "feature", "value", F.col("plastic_type").alias("product_cat")))


@query(
    "join_in_chunks",
    """WITH n AS (SELECT s_name, s_suppkey, (row_number() OVER (ORDER BY s_suppkey) - 1) // 5 AS line FROM supplier)
SELECT CAST(line AS INTEGER) AS line, string_agg(s_name, ', ' ORDER BY s_suppkey) AS names FROM n GROUP BY ALL""",
)
def _chunks(spark, sf):
    return join_in_chunks(table(spark, sf, "supplier"), "s_suppkey", "s_name")


# files -----------------------------------------------------------------------------------------------------------

def _folder(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query(
    "read_peaks",
    """SELECT concat('batch=', CAST(l_linenumber AS VARCHAR)) AS file_group, count(*) AS n, sum(round(l_extendedprice * 100)) AS total
FROM lineitem WHERE l_linenumber <> 3 GROUP BY ALL""",
)
def _read(spark, sf):
    """Peaks written as CSV folders and read back with their folder as the file tag; one folder is excluded by name."""
    where = _folder(spark, "peaks")
    line = table(spark, sf, "lineitem").select(
        F.col("l_linenumber").alias("batch"), F.round(F.col("l_extendedprice") * 100).alias("Area"),
        F.col("l_quantity").alias("m.z"), F.col("l_discount").alias("RT"),
    )
    files.write_table(line, where, "csv", partition_by=["batch"])
    from peakweave.schema import _schema
    from pyspark.sql import types as T

    schema = _schema(**{"Area": T.DoubleType(), "m.z": T.DoubleType(), "RT": T.DoubleType()})
    kept = files.read_peaks(spark, where + "/*", schema, exclude=["batch=3"], by_folder=True)
    return kept.groupBy(F.col("file").alias("file_group")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


@query(
    "read_results",
    """WITH a AS (SELECT CASE o_orderkey % 3 WHEN 0 THEN 'GC' WHEN 1 THEN 'HPLC' ELSE 'ICP' END AS technique,
round(o_totalprice) AS score FROM orders)
SELECT technique, 'GBM' AS algo, count(*) AS n, sum(score) AS total FROM a GROUP BY ALL""",
)
def _results(spark, sf):
    from peakweave.schema import _schema
    from pyspark.sql import types as T

    where = _folder(spark, "results")
    pick = F.col("o_orderkey") % 3
    scores = table(spark, sf, "orders").select(
        F.when(pick == 0, "GC").when(pick == 1, "HPLC").otherwise("ICP").alias("technique"), F.round("o_totalprice").alias("score")
    )
    for t in ("GC", "HPLC", "ICP"):
        files.write_table(scores.filter(F.col("technique") == t).select("score"), f"{where}/{t}", "csv")
    got = files.read_results(spark, where, _schema(score=T.DoubleType()), glob="part-*.csv")
    return got.groupBy("technique", "algo").agg(F.count(F.lit(1)).alias("n"), F.sum("score").alias("total"))


@query(
    "read_with_banner",
    """SELECT count(*) AS n, sum(round(o_totalprice * 100)) AS total FROM orders""",
)
def _banner(spark, sf):
    from peakweave.schema import _schema
    from pyspark.sql import types as T

    where = _folder(spark, "banner")
    body = table(spark, sf, "orders").select(F.concat_ws(",", F.round(F.col("o_totalprice") * 100), "o_orderkey").alias("value"))

    def as_export(batches):
        # every file that is written begins with a banner, whose second field is a number, and a header
        for n, batch in enumerate(batches):
            if n == 0:
                yield pa.RecordBatch.from_arrays([pa.array(["Instrument export,2023", "value,scan"], batch.schema.field(0).type)], schema=batch.schema)
            yield batch

    body.mapInArrow(as_export, "value string").write.text(where)
    got = files.read_with_banner(spark, where, _schema(value=T.DoubleType(), scan=T.StringType()), 1, glob="*.txt")
    return got.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


@query("read_sheets", f"WITH {LABELS_SQL} SELECT source AS sheet, file, subcategory FROM labelled_files")
def _sheets(spark, sf):
    where = _folder(spark, "sheets")
    files.write_table(labelled_files(spark, sf).select(F.col("source").alias("sheet"), "file", "subcategory"), where, partition_by=["sheet"])
    return files.read_sheets(spark, where)


@query(
    "read_feature_list",
    f"WITH {PEAKS_SQL} SELECT scan, line FROM peaks WHERE feature IN (SELECT feature FROM peaks WHERE value > 10000000)",
)
def _feature_list(spark, sf):
    where = _folder(spark, "features")
    data = peaks(spark, sf)
    listed = data.filter(F.col("value") > 10_000_000).select(F.col("feature").cast("string").alias("feature")).distinct()
    files.write_table(listed, where, "csv")
    wanted = files.read_feature_list(spark, where)
    return data.join(wanted, data["feature"].cast("string") == wanted["feature"], "left_semi").select("scan", "line")
