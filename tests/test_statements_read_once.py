"""Extraction deals blocks by document once and reads each different statement once; the words that it asks for first leave nothing out."""

import re

from quillcheck import composed_rules
from quillcheck.operators import extraction
from quillcheck.sources import staging
from tests.conftest import rows

SF = "/root/testdata/sf0.001"
LINES = [
    *(re.sub(r"\{\w\}", "12", s) for s in composed_rules.STATEMENTS), "КЕГЛЬ ОСНОВНОГО ТЕКСТА 14 ПТ; шрифт Arial.", "Отступ слева — 2 см.", "Отступ первой строки — нет.", "20 мм — в верхней и нижней частях страницы; 3 см - в левой части страницы.", "10 мм — в правой части страницы.", "Сверху, снизу — 2 см.", "Не отрывать от следующего.", "Не разрывать абзац.",
    "Приложения начинать с новой страницы.", "В таблице без абзацного отступа.", "Интервал перед и после — 6 пт.", "ПРИМЕР: кегль 10 пт.", "Цвет шрифта чёрный.", "Заголовки полужирные.", "Курсив | кегль 12 пт | цвет чёрный", "Необходимо не менее 20 источников!  Следует указать.", "Для бакалавра – 40-60 страниц.", "Работа состоит из частей, структура включает введение и заключение.",
    "Введение: актуальность, цели и задачи, объект и предмет.", "Тире длинное и короткое между числами.", "Не использовать повелительного наклонения.", "Заключение должно содержать выводы.", "Простой текст без правил.",
]


def made(spark):
    return spark.createDataFrame([(f"d{d}", 2 * i + k, t if k else f"4.{i + 1}  Общее") for d in range(2) for i, x in enumerate(LINES) for k, t in ((0, ""), (1, x))], "source_document string, block_ix int, text string")


def test_words_asked_for_leave_nothing_out(spark, monkeypatch):
    found = sorted(map(str, rows(extraction.extracted(made(spark)))))
    monkeypatch.setattr(extraction, "DIRECT_WORDS", ("",))
    monkeypatch.setattr(extraction, "STRUCTURAL_WORDS", ("",))
    assert found == sorted(map(str, rows(extraction.extracted(made(spark)))))
    parameters = {p for p, *_ in extraction.EXTRACTORS} | {"left_indent", "space_after", "keep_with_next", "keep_together", "page_break_before", "right_margin", "references_min_count", "recommended_work_volume", "introduction_required_content", "required_document_structure", "forbidden_phrases"}
    assert not {p for p in parameters - {"bold", "italic", "font_color"} if f"'{p}'" not in " ".join(found)}


def test_each_different_statement_is_read_once(spark):
    texts = ("Кегль 12 пт.", "Кегль 12 пт.", "Просто текст.", "Кегль 12 пт.")
    statements = spark.createDataFrame([(f"d{i}", 1, "4.1", 0, 0, t, "requirement", None if i < 3 else "footnote", "requirement", "mandatory") for i, t in enumerate(texts)], "source_document string, section_ix int, number string, fragment_ix int, statement_ix int, text string, fragment_type string, context string, statement_type string, modality string")
    assert sorted(map(str, rows(extraction._readings(statements).select("text", "context")))) == ["('Кегль 12 пт.', 'footnote')", "('Кегль 12 пт.', None)"]
    found = extraction.candidates(statements).where("parameter = 'font_size'").select("source_document", "target")
    assert sorted(map(str, rows(found))) == ["('d0', None)", "('d1', None)", "('d3', 'footnote')"]


def test_blocks_are_dealt_once(spark, monkeypatch):
    written = {}

    def seen(df, name, key, partitions):
        written[name] = (partitions, re.findall(r"Exchange hashpartitioning\(source_document[^()]*, (\d+)\)", df._jdf.queryExecution().executedPlan().toString()))
        return staging.staged_by(df, name, key, partitions)

    monkeypatch.setattr(staging, "TASK_ROWS", 1000)
    monkeypatch.setattr(extraction, "staged_by", seen)
    blocks = composed_rules.blocks(spark, SF)
    extraction.extracted(blocks)
    need = -(-blocks.count() // 1000)
    assert need > 1 and written == {"extraction-sections": (need, [str(need)]), "extraction-statements": (need, []), "extraction-candidates": (need, [])}
