"""Extraction cuts its plan: rows that several branches read are written once."""

from quillcheck.operators import extraction


def test_candidates_do_not_read_the_blocks_again(spark, tmp_path):
    at = str(tmp_path / "blocks")
    spark.createDataFrame([("d", 0, "4.1 Общее"), ("d", 1, "Основной текст должен иметь кегль 12 пт.")], "source_document string, block_ix int, text string").write.parquet(at)
    found = extraction.extracted(spark.read.parquet(at))
    assert not any(at in f for f in found.inputFiles())
    assert [(r.target, r.parameter, r.value_num, r.status) for r in found.collect()] == [("main_text", "font_size", 12.0, "extracted")]
