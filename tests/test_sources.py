import json

import pytest

from haplospark.functions import scalar
from haplospark.sources import readers
from haplospark.streaming.support import streaming_support


def test_regions():
    assert readers.parse_region("chr20:1,000-2,500") == readers.Region("chr20", 1000, 2500)
    for bad in ("chr20", "chr20:9-1", ":1-2"):
        with pytest.raises(ValueError):
            readers.parse_region(bad)
    c = readers.RunConfig.of({"top_k": 8, "odd": 1})
    assert c.top_k == 8 and c.extra == {"odd": 1}


def test_files(spark, tmp_path):
    (tmp_path / "v.json").write_text(json.dumps([{"pos": p, "ref_allele": "A", "alt_allele": "C", "genotype": [0, 1]} for p in (101, 251, 9999)]))
    region = readers.Region("chr20", 100, 300)
    assert [r.pos for r in readers.read_variants(spark, str(tmp_path / "v.json"), region).collect()] == [101, 251]
    (tmp_path / "r.json").write_text(json.dumps([{"read_id": "r1", "site_pos": 101, "allele": 1, "baseq": 30, "mapq": 60}, {"read_id": "r3", "site_pos": 9999, "allele": 1, "baseq": 30, "mapq": 60}]))
    assert readers.read_observations(spark, str(tmp_path / "r.json"), region).count() == 1
    (tmp_path / "p.json").write_text(json.dumps({"entries": [{"pos": 251, "bias": -0.3}, {"pos": 101, "bias": 0.2}]}))
    assert [(r.pos, r.bias) for r in readers.read_priors(spark, str(tmp_path / "p.json")).collect()] == [(101, 0.2), (251, -0.3)]
    (tmp_path / "panel.json").write_text(json.dumps([{"donor_id": "d1", "hap_id": 0, "group": "eur", "alleles": [1, 1, -1]}]))
    readers.pack_panel(spark, str(tmp_path / "panel.json"), str(tmp_path / "panel.parquet"))
    assert readers.read_panel(spark, str(tmp_path / "panel.parquet")).first().alleles == [1, 1, -1]
    (tmp_path / "b.bed").write_text("chr1\t5\t10\textra\nchr1\t20\t20\n")
    assert [(r.start, r.end) for r in readers.read_bed(spark, str(tmp_path / "b.bed")).collect()] == [(5, 10)]
    (tmp_path / "m.map").write_text("chr id cM bp\nchr1 . 0.5 2000\nchr1 . 0.1 1000\nshort\n")
    assert [(r.bp, r.cm) for r in readers.read_genetic_map(spark, str(tmp_path / "m.map")).collect()] == [(1000, 0.1), (2000, 0.5)]
    (tmp_path / "c.vcf").write_text("##x\n#CHROM\nchr1\t5\t.\tA\tC\t.\t.\t.\tGT:PS\t0|1:77\nchr1\t6\t.\tA\tG\t.\t.\t.\tGT\t0/1\n")
    assert [(r.pos, r.gt, r.ps) for r in readers.read_vcf(spark, str(tmp_path / "c.vcf")).collect()] == [(5, "0|1", "77"), (6, "0/1", None)]
    a, b = spark.createDataFrame([(1, "x")], "p int, q string"), spark.createDataFrame([(2, 3.5)], "p int, z double")
    readers.write_tsv([a, b], str(tmp_path / "t"))
    assert readers.read_tsv(spark, str(tmp_path / "t")).columns == ["p", "q", "z"]


def test_scalars(spark):
    df = spark.createDataFrame([("ACGTTTT", "alt", "7.9", "yes"), ("", "C", "x", None)], "s string, a string, n string, t string")
    from pyspark.sql import functions as F

    rows = df.select(scalar.longest_homopolymer(F.col("s")), scalar.gc_fraction(F.col("s")), scalar.parse_allele(F.col("a"), F.lit("C"), F.lit("G")), scalar.lenient_long(F.col("n"), -1), scalar.truthy(F.col("t"))).collect()
    assert tuple(rows[0]) == (4, 2 / 7, 1, 7, True) and tuple(rows[1]) == (0, 0.0, -1, -1, False)
    assert {readers.block_or_null(F.lit(x)) is not None for x in ("", "b")} == {True}


def test_stream_equals_batch(spark, tmp_path):
    df = spark.createDataFrame([(0, 100, 1, 0.5), (0, 100, -1, 1.0), (0, 200, 1, None), (0, 200, 0, 1.0)], "w long, pos long, allele int, weight double")
    df.repartition(2).write.parquet(str(tmp_path / "in"))
    q = streaming_support(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("support").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted(map(tuple, spark.table("support").collect()))
    assert got == sorted(map(tuple, streaming_support(df).collect())) == [(0, 100, 0.5, 1.0, 2), (0, 200, 1.0, 0.0, 1)]


def test_json_cells_and_config(spark, tmp_path):
    rows = [("a", "[10, 20]", "[1, -1]", "[0.5, 2]"), ("b", '["30"]', '["-1"]', None), ("c", "[]", "[]", "[]"), ("d", "oops", "[1]", "[1]"), ("e", None, None, None), ("f", "[1, 2]", "[1]", "[]")]
    got = readers.fragments_from_cells(spark.createDataFrame(rows, "read_id string, positions string, alleles string, weights string"), "read_id").collect()
    assert sorted(map(tuple, got)) == [("a", 10, 1, 0.5), ("a", 20, -1, 2.0), ("b", 30, -1, 1.0), ("f", 1, 1, 1.0)]
    (tmp_path / "run.yaml").write_text("sample_id: s1\ntop_k: 5\nmore: [1, 2]\n")
    c = readers.read_config(str(tmp_path / "run.yaml"))
    assert (c.sample_id, c.top_k, c.extra) == ("s1", 5, {"more": [1, 2]})
    (tmp_path / "bad.yaml").write_text("- 1")
    with pytest.raises(ValueError):
        readers.read_config(str(tmp_path / "bad.yaml"))


def test_branch_configs():
    text = "inputs:\n  target_reads: old.json  # all\n  panel: p\nother_target_reads: x\n"
    got = readers.branch_configs(text, "out/w7")
    assert set(got) == {"selected", "tagged", "superreads"}
    assert got["tagged"] == "inputs:\n  target_reads: out/w7_tagged.json\n  panel: p\nother_target_reads: x\n"
    with pytest.raises(ValueError):
        readers.branch_configs("inputs: {}", "s")
