from siteweave.streaming.scoring import score_stream

from .test_operators import MODEL


def test_stream_scores_equal_the_published_ones(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("1,AGUAC,BID\n2,GAUCG,BACS\n3,AUUAG,BID\n4,AGUAC,OTHER\n")
    sites = spark.readStream.schema("site_id string, motif string, source_assay string").csv(str(tmp_path / "in"))
    prints = spark.createDataFrame([("AGUAC", 0.23147377744815234), ("GAUCG", 0.23147377744815323)], "motif string, log_ratio double")
    model = [dict(zip(("feature", "coefficient", "mean", "scale"), r, strict=True)) for r in MODEL]
    out = score_stream(sites, model, prints, ["BID", "BACS", "ELAP"], ("ELAP", "BID"))
    run = out.select("site_id", "score").writeStream.format("memory").queryName("scored").start()
    run.processAllAvailable()
    run.stop()
    got = {r["site_id"]: r["score"] for r in spark.table("scored").collect()}
    assert abs(got["1"] + 2.0419292141285528) < 1e-9 and abs(got["2"] + 1.8475356295452217) < 1e-9 and got["3"] is None and got["4"] is None
