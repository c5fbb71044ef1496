"""Readers and writers of the domain's files; every result is a DataFrame in the engine's schemas."""

from __future__ import annotations

import re
import tempfile
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

VARIANTS = "pos long, ref_allele string, alt_allele string, genotype array<tinyint>"
OBSERVATIONS = (
    "read_id string, site_pos long, allele tinyint, baseq int, mapq int, raw_baseq double, weight_v2 double, weight_v3 double, local_ref_score double, local_alt_score double, "
    "allele_score_delta double, allele_confidence double, is_ambiguous boolean, context_bases_compared int, variant_class string, penalty_multiplier double"
)
PANEL = "donor_id string, hap_id int, `group` string, alleles array<tinyint>"
PRIORS = "entries array<struct<pos: long, bias: double>>"
BLOCKS = "block_id string, orientation_bias double, support_weight double, informative_sites int, abstained_sites int, mean_confidence double, signed_confidence_sum double, coherence double"
_REGION = re.compile(r"^([^:]+):([\d,]+)-([\d,]+)$")
#: Texts that stand for no block.
NO_BLOCK = ("", "0", "unassigned", ".", "NA", "na", "none")


@dataclass(frozen=True)
class Region:
    """Inclusive, 1-based."""

    chrom: str
    start: int
    end: int


def parse_region(text: str) -> Region:
    m = _REGION.match(text.strip())
    if not m:
        raise ValueError(f"not a region: {text!r}")
    region = Region(m[1], int(m[2].replace(",", "")), int(m[3].replace(",", "")))
    if region.start > region.end:
        raise ValueError(f"region ends before it starts: {text!r}")
    return region


@dataclass(frozen=True)
class RunConfig:
    """Parameters of a run; unknown keys are kept in ``extra``."""

    sample_id: str = ""
    region: str = ""
    top_k: int = 32
    composites: int = 16
    min_informative_sites: int = 4
    min_confidence: float = 0.6
    extra: dict = field(default_factory=dict)

    @staticmethod
    def of(values: dict) -> RunConfig:
        names = set(RunConfig.__dataclass_fields__) - {"extra"}
        return RunConfig(**{k: v for k, v in values.items() if k in names}, extra={k: v for k, v in values.items() if k not in names})


def read_config(path: str) -> RunConfig:
    """Run parameters from a YAML or JSON file on the driver; only mappings of plain values."""
    import yaml

    with open(path) as f:
        values = yaml.safe_load(f)
    if not isinstance(values, dict):
        raise ValueError(f"not a mapping: {path!r}")
    return RunConfig.of(values)


def branch_configs(text: str, stem: str, branches: tuple[str, ...] = ("selected", "tagged", "superreads")) -> dict[str, str]:
    """The text of a run's parameters for each read branch: ``target_reads`` names that branch's file, all other lines stay."""
    line = re.compile(r"^(\s*)target_reads:.*$", re.MULTILINE)
    if not line.search(text):
        raise ValueError("no target_reads among the parameters")
    return {b: line.sub(lambda m: f"{m[1]}target_reads: {stem}_{b}.json", text) for b in branches}


def scratch_dir(spark: SparkSession) -> str:
    """A new folder that driver and executors share, under ``spark.checkpoint.dir``; only in local mode one of this machine."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="results-")
    return f"{path.rstrip('/')}/results-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder, for what several plans read: computed once, and not again when an executor is lost."""
    path = scratch_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fragments_from_cells(rows: DataFrame, *keys: str) -> DataFrame:
    """One row for each observation of cells that hold JSON lists: ``positions``, ``alleles``, ``weights``.

    Numbers in quotes count; a cell that is null, empty or no list gives no
    observations; a missing weight is 1; positions without an allele are dropped.
    """
    listed = lambda c: F.transform(F.from_json(F.col(c).cast("string"), "array<string>"), lambda x: x.try_cast("double"))
    cells = rows.select(*keys, F.arrays_zip(listed("positions").alias("pos"), listed("alleles").alias("allele"), F.coalesce(listed("weights"), F.array().cast("array<double>")).alias("weight")).alias("x"))
    out = cells.select(*keys, F.explode("x").alias("x")).where("x.pos IS NOT NULL AND x.allele IS NOT NULL")
    return out.select(*keys, F.col("x.pos").cast("long").alias("pos"), F.col("x.allele").cast("int").alias("allele"), F.coalesce("x.weight", F.lit(1.0)).alias("weight"))


def _json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_variants(spark: SparkSession, path: str, region: Region | None = None) -> DataFrame:
    out = _json(spark, path, VARIANTS)
    return out.where(F.col("pos").between(region.start, region.end)) if region else out


def read_observations(spark: SparkSession, path: str, region: Region | None = None) -> DataFrame:
    out = _json(spark, path, OBSERVATIONS)
    return out.where(F.col("site_pos").between(region.start, region.end)) if region else out


def read_panel(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PANEL).parquet(path) if path.endswith(".parquet") else _json(spark, path, PANEL)


def pack_panel(spark: SparkSession, source: str, target: str) -> None:
    """The packed form of a panel is Parquet."""
    read_panel(spark, source).write.mode("overwrite").parquet(target)


def read_priors(spark: SparkSession, path: str, region: Region | None = None) -> DataFrame:
    out = _json(spark, path, PRIORS).select(F.explode("entries").alias("e")).select("e.pos", "e.bias")
    return (out.where(F.col("pos").between(region.start, region.end)) if region else out).orderBy("pos")


def read_block_summaries(spark: SparkSession, path: str) -> DataFrame:
    return _json(spark, path, BLOCKS)


def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    """All columns are strings; casts are lenient and made by the operators."""
    return spark.read.option("header", True).option("sep", "\t").csv(path)


def write_tsv(frames: list[DataFrame], path: str) -> None:
    """Several tables as one, with the union of their columns in the order they are first seen."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    out.write.mode("overwrite").option("header", True).option("sep", "\t").csv(path)


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    """0-based half-open intervals."""
    return spark.read.option("sep", "\t").option("comment", "#").csv(path).selectExpr("_c0 AS chrom", "CAST(_c1 AS BIGINT) AS start", "CAST(_c2 AS BIGINT) AS end").where("start IS NOT NULL AND start < end")


def read_genetic_map(spark: SparkSession, path: str) -> DataFrame:
    """At least four columns; the last two are centimorgan and base pair."""
    f = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where(F.size(f) >= 4).select(F.element_at(f, -1).try_cast("long").alias("bp"), F.element_at(f, -2).try_cast("double").alias("cm"))
    return rows.where("bp IS NOT NULL AND cm IS NOT NULL").orderBy("bp")


def read_vcf(spark: SparkSession, path: str) -> DataFrame:
    """Plain-text VCF, first sample: chrom, pos, ref, alt, gt, ps."""
    lines = spark.read.text(path).where(~F.col("value").startswith("#"))
    f = F.split("value", "\t")
    keys, vals = F.split(f[8], ":"), F.split(f[9], ":")
    part = lambda name: F.get(vals, (F.array_position(keys, name) - 1).cast("int"))
    return lines.select(f[0].alias("chrom"), f[1].cast("long").alias("pos"), f[3].alias("ref"), f[4].alias("alt"), part("GT").alias("gt"), part("PS").alias("ps"))


def block_or_null(c):
    """A block id, or null for any of the texts that mean none."""
    return F.when(F.trim(c).isin(*NO_BLOCK), None).otherwise(F.trim(c))


def write_results(frames: dict[str, DataFrame], folder: str, formats: dict[str, str] | None = None) -> None:
    """Each table under its name, as Parquet unless ``formats`` says json or csv."""
    for name, f in frames.items():
        kind = (formats or {}).get(name, "parquet")
        writer = f.write.mode("overwrite")
        (writer.option("header", True) if kind == "csv" else writer).format(kind).save(f"{folder}/{name}")
