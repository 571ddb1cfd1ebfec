"""Column expressions that read meaning out of names: rules, tokens, replicate tags, metal names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Rules = Sequence[tuple[str, str]]

# Fixed values: (substring of the file name, label), first match wins.
PRODUCT_RULES: Rules = (
    ("Balloons", "Toys"),
    ("FPW_", "Food contact materials"),
    ("Pbal_Sample", "Toys"),
    ("MPW_", "Mixed_Plastic_Waste"),
    ("PBBC_", "Food contact materials"),
    ("Pbag_", "Food contact materials"),
    ("PDS_Sample", "Food contact materials"),
    ("Pcut_Sample", "Food contact materials"),
    ("PC_Sample", "Food contact materials"),
    ("Cigs_", "Cigarettes"),
    ("Cmat", "Construction materials"),
    ("Mask_Sample", "Clothes"),
)
PRODUCT_DEFAULT = "Misc"

# Fixed values.
SHORT_PRODUCT_RULES: Rules = (
    ("Balloons", "Toys"),
    ("FPW", "Food contact materials"),
    ("Pbal", "Toys"),
    ("MPW", "Mixed_Plastic_Waste"),
    ("PBBC", "Food contact materials"),
    ("Pbag", "Food contact materials"),
    ("PDS", "Food contact materials"),
    ("Pcut", "Food contact materials"),
    ("PC", "Food contact materials"),
    ("Cigs", "Cigarettes"),
    ("Cmat", "Construction materials"),
    ("Mask", "Clothes"),
)

# Fixed values.
SITE_PRODUCT_RULES: Rules = (
    ("USE-01", "Food contact materials"),
    ("USE-02", "Mixed_Plastic_Waste"),
    ("USE-03", "Food contact materials"),
    ("USE-05", "Cigarettes"),
    ("USE-07", "Food contact materials"),
    ("USE-09", "Food contact materials"),
    ("USE-11", "Toys"),
    ("USE-13", "Food contact materials"),
    ("USE-14", "Food contact materials"),
)

# Fixed values.
SITE_CODES = (
    "USE-01", "USE-02", "USE-03", "USE-05", "USE-06", "USE-07",
    "USE-09", "USE-11", "USE-12", "USE-13", "USE-14",
)
SITE_DEFAULT = "USE-15"

# Fixed values.
PLASTIC_TYPE_RULES: Rules = (
    ("Balloons", "Balloons"),
    ("FPW_", "Food_Packaging_Waste"),
    ("MPW_", "Mixed_Plastic_Waste"),
    ("PBBC_", "Plastic_Bottles_and_Bottle_Caps"),
    ("PC_Sample", "Plastic_Cups"),
    ("PDS_Sample", "Plastic_Drinking_Straws"),
)
PLASTIC_TYPE_DEFAULT = "Other"

# Fixed values.
PLASTIC_CODE_RULES: Rules = (
    ("FPW_", "0"),
    ("Balloons", "1"),
    ("MPW_", "2"),
    ("PBBC_", "3"),
    ("PC_Sample", "4"),
    ("PDS_Sample", "5"),
)
PLASTIC_CODE_DEFAULT = "6"

# Fixed values.
METAL_CATEGORY_RULES: Rules = (
    ("USE-01", "Polystyrene food packaging"),
    ("USE-02", "Mixed plastic waste"),
    ("USE-03", "Plastic drinking straws"),
    ("USE-05", "Cigarettes tips"),
    ("USE-06", "Face masks"),
    ("USE-07", "Food containers"),
    ("USE-09", "Food wrappers"),
    ("USE-11", "Plastic toy balls"),
    ("USE-12", "Ziploc bags"),
    ("USE-13", "Food packaging"),
    ("USE-14", "Bottle caps"),
)
METAL_CATEGORY_DEFAULT = "Fishing bait trays"

# Fixed values.
SOURCE_RULES: Rules = (("USE", "Environmental"),)
SOURCE_DEFAULT = "Store-Bought"

# Fixed values.
DAY_RULES: Rules = (("Day0", "0"), ("Day2", "2"), ("Day15", "15"))
DAY_DEFAULT = "34"

# Fixed values.
ALGORITHM_RULES: Rules = (
    ("LGBM", "LGBM"),
    ("RF", "RF"),
    ("MLR", "MLR"),
    ("SVM", "SVM"),
    ("XGB", "XGB"),
    ("CNB", "CNB"),
    ("KNN", "KNN"),
)
ALGORITHM_DEFAULT = "GBM"

# Polymer names looked for in sample names whatever their case, in this order.
POLYMERS = (
    "ULDPE", "LLDPE1", "LLDPE2", "LDPE1", "LDPE2", "MDPE", "HDPE1", "HDPE2", "PP", "PEST", "PET1",
    "PET2", "EVA", "ABS", "EPS", "PS", "PA6", "PA66", "PVC1", "PVC2", "CR",
)
POLYMER_DEFAULT = "CA"

# Elements of seawater and the gas mode left out.
SEAWATER_ELEMENTS = ("Na", "Mg", "K", "Ca")
DROPPED_GAS_MODE = "H2 HMI"


def classify_by_name(col: Column | str, rules: Rules, default: str | None, ignore_case: bool = False) -> Column:
    """Label of the first rule whose text occurs in the name; a null name has no label."""
    c = F.col(col) if isinstance(col, str) else col
    text = F.upper(c) if ignore_case else c
    picked = F.when(c.isNull(), F.lit(None).cast("string"))
    for part, label in rules:
        picked = picked.when(text.contains(part.upper() if ignore_case else part), label)
    return picked.otherwise(default)


def classify_regex_ci(col: Column | str, longest_first: bool = False) -> Column:
    """Polymer named in a sample, whatever its case.

    In the given order PA66 can never match, because PA6 comes first; `longest_first` tries longer names first.
    """
    names = sorted(POLYMERS, key=len, reverse=True) if longest_first else POLYMERS
    return classify_by_name(col, [(n, n) for n in names], POLYMER_DEFAULT, ignore_case=True)


def file_stem(col: Column) -> Column:
    """Hyphens instead of underscores, and no `.csv`."""
    return F.regexp_replace(F.translate(col, "_", "-"), ".csv", "")


def replicate_tag(name: Column, three: bool = True) -> Column:
    if three:
        return F.when(name.contains("R1"), "R1").when(name.contains("R2"), "R2").otherwise("R3")
    return F.when(name.contains("R1"), "R1").otherwise("R2")


def name_tokens(name: Column, first: int, count: int = 2, sep: str = "-") -> Column:
    """Tokens first, first+1, ... of a separated name, joined again."""
    return F.array_join(F.slice(F.split(name, sep), first, count), sep)


# Which tokens of the file name identify the sample, by run type.
SAMPLE_TOKENS = {"GC": (4, 2), "0": (1, 2), "1": (2, 2), "2": (2, 2)}


def parse_file_name(df: DataFrame, file: str = "file", kind: str = "GC") -> DataFrame:
    """Tags read from the file name. `kind` is GC or the batch number of a liquid chromatography run."""
    name = file_stem(F.col(file)) if kind == "GC" else F.translate(F.col(file), "_", "-")
    start, count = SAMPLE_TOKENS[kind]
    out = df.withColumn(file, name).withColumn("replicate", replicate_tag(F.col(file), three=kind == "GC"))
    if kind != "GC":
        out = (
            out.withColumn("type", F.when(F.col(file).contains("Blank"), "Blanks").otherwise("Sample"))
            .withColumn("day", classify_by_name(file, DAY_RULES, DAY_DEFAULT))
            .withColumn("batch", F.lit(kind))
        )
    return out.withColumn("simplified_file", name_tokens(F.col(file), start, count))


def clean_metal_name(col: Column | str) -> Column:
    """Element name without isotope numbers, mass shift and gas mode."""
    c = F.col(col) if isinstance(col, str) else col
    head = F.trim(F.regexp_extract(c, r"^[^\[]+", 0))
    return F.regexp_replace(head, r"\d+ *(-> *\d+)? *", "")


def gas_mode(col: Column | str) -> Column:
    """Text between the brackets that end a metal name; null when there is none."""
    c = F.col(col) if isinstance(col, str) else col
    return F.nullif(F.regexp_extract(c, r"^(.*\[ )([A-Za-z0-9 ]+)( \])$", 2), F.lit(""))


def drop_gas_mode(df: DataFrame, feature: str = "feature", mode: str = DROPPED_GAS_MODE) -> DataFrame:
    """Rows measured in another gas mode; a name without a mode is dropped too."""
    return df.filter(~gas_mode(feature).contains(mode))


def drop_elements_by_pattern(
    df: DataFrame, feature: str = "feature", parts: Sequence[str] = SEAWATER_ELEMENTS
) -> DataFrame:
    """Rows whose name holds none of the given texts (case matters)."""
    return df.filter(~F.col(feature).rlike("|".join(parts)))


def strip_replicate_suffix(col: Column | str) -> Column:
    """`x_rep3` -> `x`, for replicates 1 to 5."""
    c = F.col(col) if isinstance(col, str) else col
    return F.regexp_replace(c, "_rep[1-5]", "")


def dots_to_spaces(col: Column | str) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.translate(c, ".", " ")


def identifier(col: Column | str) -> Column:
    """Name usable as an identifier: other characters become dots, and X is put before a digit."""
    c = F.col(col) if isinstance(col, str) else col
    dotted = F.regexp_replace(c, r"[^A-Za-z0-9._]", ".")
    return F.when(dotted.rlike(r"^([0-9_]|\.[0-9])"), F.concat(F.lit("X"), dotted)).otherwise(dotted)


def feature_label(feature: Column, mean_mz: Column, mean_rt: Column) -> Column:
    """Display name of a feature with its position."""
    return F.concat(
        feature.cast("string"), F.lit("_m/z: "), mean_mz.cast("string"), F.lit("_RT: "), mean_rt.cast("string")
    )


def file_class_label(file: Column, label: Column) -> Column:
    return F.concat_ws("_", file.cast("string"), label)


def excel_serial_to_date(col: Column | str) -> Column:
    """Day number of a spreadsheet as a date; text that is no number gives null."""
    c = F.col(col) if isinstance(col, str) else col
    return F.date_add(F.lit("1899-12-30").cast("date"), c.try_cast("int"))
