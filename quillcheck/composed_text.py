"""Queries over lines of text that are composed from order lines, one form for each typography pattern, with SQL to hold them against.

The patterns look around and know Unicode word boundaries. The SQL engine has neither, so its patterns
are written anew with groups for the context; the first group that matched is the fragment.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillcheck.functions import fixed
from quillcheck.operators import corrections, typography
from quillcheck.registry import query

#: Forms of lines; {n} is a number of one digit, {m} one of two.
FORMS = (
    "Обычный текст без ошибок.", "два  пробела {n}", "табы\t\tтут", "знак , далее", "скобка ( тут", "скобка тут )", "см. рис. {n} а тут", "г. Москва", "А. Б. Иванов", "дом № {n}", "закон § {n}", "как таблица {n} есть", "длина {m} см тут", "a + b = c", "да / нет", "размер {m} x {n} тут", "стоит =-{n} тут",
    "число {m}.{n} есть", "тепло {m} oC тут", "страницы {n}-{m} тут", "года {n} — {m} тут", "от −{n} — {m} тут", "жара {m}°C тут", "жара {m} ° тут", "доля {m} % тут", "сила Н·м тут", "около ± {n} раз", "длина {m} см. и тут", "работа A Дж тут", "тут ln x и", "по {n} кг, {m} кг тут", "сумма {m}{m}{n} руб",
    "кто - что", "конец пере-", "кто—что", "«кто «что» где»", "пункт No {n}", "и/или/нет", "цитата [...] конец", "мотив C-dur тут", " край", "он \"сказал\" это", "ссылка [см. тут] и [{n}]", "тел. 8(912)345-67-89", "Сайт https://a.ru и {m}.{n} там", "Версия {n}.{n}.{n}", "[{n}] Иванов  И.", "ГОСТ Р 1.5-2012 и {m} см",
    "import  os", "примечание без точки", "Таблица {n} — Данные.", "УДК {m}.{n}.", "тел. 8 912 345-67-89", "ссылка [{n}; {n}] тут", "счёт {m}:{n} тут", "время {n} : {m} тут", "5 % г", "п. {n} б)", "в {m}{m} году", "край ", "пункт № {n} и {m} кг", "почта a.b@c.ru и {m} x {n}",
)


def _line(form: str) -> str:
    quoted = form.replace("'", "''")
    return "concat('" + quoted.replace("{n}", "', n, '").replace("{m}", "', m, '") + "')"


LINES = f"""
SELECT doc_id, para_ix, v, CASE v WHEN 49 THEN 'note' WHEN 50 THEN 'caption' ELSE 'main_text' END AS paragraph_type, CASE WHEN v = 50 THEN 'table' END AS caption_kind, CASE v {" ".join(f"WHEN {i} THEN {_line(f)}" for i, f in enumerate(FORMS))} END AS text
FROM (SELECT CAST(floor(l_orderkey / 3.0) AS BIGINT) AS doc_id, CAST((l_orderkey % 3) * 8 + l_linenumber AS INT) AS para_ix, CAST(max(l_partkey + l_suppkey) % {len(FORMS)} AS INT) AS v, CAST(max(l_suppkey) % 9 + 1 AS STRING) AS n, CAST(max(l_partkey) % 80 + 10 AS STRING) AS m FROM {{lineitem}} GROUP BY 1, 2) AS made"""

_S, _W = r"[\s\p{Z}]", r"[\p{L}\p{N}_]"
_B, _E = r"(?:^|[^\p{L}\p{N}_])", r"(?:$|[^\p{L}\p{N}_])"
_UNIT = "|".join(sorted(fixed.UNITS, key=len, reverse=True))
_NUM = r"\d+(?:[,.]\d+)?"
_GAP = f"[ {fixed.NBSP}]"
_UNITS_AFTER = "|".join(rf"\d+{_S}*{u}{_S}*,{_S}*\d+{_S}*{u}" for u in ("мм", "см", "м", "г", "кг", "Вт", "В"))
_TIMES = rf"\d({_S}*[*xX]{_S}*)(?:\d|[a-zA-Zа-яА-Я])"
_MINUS = rf"[=+{fixed.NBSP} ](-\d)|{_W}({_S}-{_S}){_W}"
_SPACED = rf"({_W}{_S}-{_S}{_W})"
_UNIT_GAP = rf"(?i){_B}({_NUM} (?:{_UNIT}))(?:$|[^\p{{L}}\p{{N}}_])|{_B}({_NUM} [%‰])[\p{{L}}\p{{N}}_]"
#: (parameter, pattern with the fragment as a group, level)
PATTERNS = (
    ("repeated_spaces", "( {2,})", "error"), ("repeated_tabs", r"(\t{2,})", "warning"), ("spaces_near_punctuation", rf"({_S}+[.,;:!?])", "error"), ("spaces_inside_brackets_quotes", rf"([(\[{{«„]{_S}+)|({_S}+[)\]}}»“])", "error"),
    ("number_letter_no_space", rf"(?i){_B}((?:рис\.|табл\.|п\.|ст\.){_S}+\d+{_S}+[а-яa-z]){_E}", "error"), ("nbsp_after_abbreviations", rf"{_B}((?:г|ул|пер|дер|пос|с|р|д|к|стр|кв|ч|гл|ст|п|пп)\. )\S", "error"), ("nbsp_between_initials", rf"{_B}([А-ЯЁA-Z]\. [А-ЯЁA-Z]\.(?: [А-ЯЁA-Z][A-Za-zА-ЯЁа-яё-]+)?)", "error"),
    ("nbsp_after_number_sign", r"(№ \d+)", "error"), ("nbsp_after_paragraph_sign", r"(§ \d+)", "error"), ("nbsp_after_figure_table_reference", rf"(?i){_B}((?:рис\.|рисунок|табл\.|таблица) \d+(?:\.\d+)*)", "error"), ("nbsp_between_number_and_unit", _UNIT_GAP, "error"),
    ("math_operator_nbsp", rf"[A-Za-z0-9]({_GAP}?[+±×·=]{_GAP}?)[A-Za-z0-9]|\d({_GAP}?:{_GAP}?)\d", "error"), ("slash_without_spaces", rf"{_W}({_S}+/{_S}+){_W}", "error"), ("wrong_multiplication_symbols", _TIMES, "error"), ("hyphen_instead_of_minus", _MINUS, "warning"),
    ("decimal_separator_comma", r"(?:^|[^\p{L}\p{N}_.])(\d+\.\d+)(?:$|[^\p{L}\p{N}_.]|\.(?:$|[^\d]))", "error"), ("degree_symbol", rf"{_B}({_NUM}{_S}*[oO]){_S}*[CFСКK]{_E}", "error"), ("multiplication_symbol", _TIMES, "error"), ("minus_symbol", _MINUS, "warning"),
    ("numeric_range_dash", rf"{_B}(\d+{_S}*-{_S}*\d+){_E}", "error"), ("numeric_range_dash", rf"{_B}(\d+{_S}+[–—]{_S}+\d+){_E}", "error"), ("numeric_range_dash", rf"([-−]\d+{_S}*[–—-]{_S}*[+-]?\d+)", "warning"), ("unit_nbsp", _UNIT_GAP, "error"), ("temperature_nbsp", rf"{_B}({_NUM}°[CFС]){_E}", "error"), ("temperature_nbsp", rf"{_B}({_NUM}{_S}+°)(?:$|[^CFС])", "error"),
    ("percent_nbsp", rf"{_B}({_NUM} [%‰])", "error"), ("dimension_operator_spacing", rf"{_B}([А-Яа-яA-Za-z]+[·×][А-Яа-яA-Za-z]+)", "error"), ("dimension_operator_spacing", rf"{_B}([+±×]{_S}+\d)", "error"), ("no_dot_after_units", rf"(?i){_B}({_NUM}{_GAP}(?:{_UNIT})\.){_S}+[а-яa-z]", "error"),
    ("variable_unit_comma", rf"{_B}([A-Za-zА-Яа-я]{_S}+(?:Дж|Вт|Па|Н|м|см|кг|г)){_E}", "error"), ("variable_unit_comma", rf"(?i){_B}((?:ln|log){_S}+{_W}+{_S}+)(?:$|[^\[])", "error"), ("unit_only_after_last_number", rf"{_B}({_UNITS_AFTER})", "warning"), ("digit_grouping_nbsp", r"(?:^|[^\p{L}\p{N}_.])([-−]?\d{5,})(?:$|[^\p{L}\p{N}_.])", "error"),
    ("hyphen_spacing", _SPACED, "error"), ("manual_hyphenation_forbidden", rf"({_W}-{_S}*)$", "warning"), ("dash_spacing", rf"({_W}—{_W})", "error"), ("hyphen_instead_of_dash", _SPACED, "error"), ("nested_quotes", "(«[^»]*«[^»]+»[^»]*»)", "error"), ("number_sign_symbol", rf"(?i){_B}((?:No?){_S}*\d+)", "error"), ("number_sign_nbsp", r"(№ \d+)", "error"),
    ("parentheses_not_slash", rf"{_B}({_W}+/[^/\s]+/)", "error"), ("citation_omission_format", r"(\[\s*\.{3}\s*\]|…|\[\s*…\s*\])", "error"), ("music_terms_typography", rf"{_B}([A-Ha-h]-?(?:dur|moll)){_E}", "warning"), ("russian_quotes", '("[^"]+")', "warning"),
)
_PHONE, _VALID_PHONE = r"(?:\+7|8)?[\s\p{Z}]?\(?\d{3}\)?[\s\p{Z}-]?\d{3}[\s\p{Z}-]?\d{2}[\s\p{Z}-]?\d{2}", r"^((\+7|8)\s)?\d{3}\s\d{3}-\d{2}-\d{2}$"


def _duck(sql: str) -> str:
    return sql.replace("{lineitem}", "lineitem")


def hits_sql(any_language: bool = False) -> str:
    """The findings of a relation named lines (doc_id, para_ix, v, paragraph_type, caption_kind, text)."""
    q = lambda p: p.replace("'", "''")
    parts = []
    for name, pattern, level in PATTERNS:
        groups = [f"regexp_extract(text, '{q(pattern)}', {k + 1})" for k in range(pattern.replace("(?:", "").replace("(?i)", "").replace(r"\(", "").replace("[(", "[").count("("))]
        fragment = f"coalesce({', '.join(f'nullif({g}, {chr(39) * 2})' for g in groups)})"
        language = " AND regexp_matches(text, '[А-Яа-яЁё]')" if name == "russian_quotes" and not any_language else ""
        parts.append(f"SELECT doc_id, para_ix, '{name}' AS parameter, {fragment} AS fragment, '{level}' AS level, text FROM scope WHERE regexp_matches(text, '{q(pattern)}'){language}")
    found = " UNION ALL ".join(parts)
    values = ", ".join(f"'{p}'" for p in fixed.VALUE_PARAMETERS)
    ignored = r"regexp_matches(text, '(?i)https?://|www\.') OR regexp_matches(text, '[\w.+-]+@[\w.-]+\.\w+') OR regexp_matches(text, '(?i)ГОСТ\s+Р?\s*\d+(\.\d+)*[-–]\d{4}') OR regexp_matches(fragment, '^\d+(\.\d+){2,3}$') OR regexp_matches(fragment, '^\d{4}$')"
    return f"""scope AS (SELECT * FROM lines WHERE text <> '' AND NOT regexp_matches(text, '^\\s*\\[\\d+\\]\\s+') AND NOT regexp_matches(text, '^\\s*(def |class |import |from |if \\(|for \\()')), found AS ({found})
SELECT doc_id, para_ix, parameter, fragment, level FROM found WHERE NOT (parameter IN ({values}) AND ({ignored}))
UNION ALL SELECT doc_id, para_ix, 'paragraph_edge_spaces', 'space at the edge', 'error' FROM scope WHERE text LIKE ' %' OR text LIKE '% '
UNION ALL SELECT doc_id, para_ix, 'square_brackets_usage', b, 'warning' FROM (SELECT *, list_filter(regexp_extract_all(text, '\\[[^\\]]+\\]'), lambda x: NOT regexp_matches(x, '(?i)^\\[\\d+(,\\s*с\\.\\s*\\d+)?(;\\s*\\d+)*\\]$'))[1] AS b FROM scope) WHERE b IS NOT NULL
UNION ALL SELECT doc_id, para_ix, 'phone_number_format', b, 'error' FROM (SELECT *, list_filter(list_transform(regexp_extract_all(text, '{_PHONE}'), lambda x: trim(x)), lambda x: NOT regexp_matches(x, '{_VALID_PHONE}'))[1] AS b FROM scope) WHERE b IS NOT NULL
UNION ALL SELECT doc_id, para_ix, 'no_dot_after_udc_keywords_table_title', '.', 'error' FROM scope WHERE (caption_kind = 'table' OR lower(text) LIKE 'удк%') AND text LIKE '%.'
UNION ALL SELECT doc_id, para_ix, 'dot_after_footnote_or_note', 'no end sign', 'error' FROM scope WHERE paragraph_type = 'note' AND NOT regexp_matches(text, '[.!?…]$')"""


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(LINES, lineitem=spark.read.parquet(f"{sf_dir}/lineitem.parquet")).withColumns({"style_name": F.lit(None).cast("string"), "logical_section": F.lit(None).cast("string")})


@query(f"WITH lines AS ({_duck(LINES)}), {hits_sql()}")
def typography_hits(spark, sf_dir):
    """Every typography pattern on lines that break it and lines that do not."""
    return typography.fragments(lines(spark, sf_dir), repeated=True).select("doc_id", "para_ix", "parameter", "fragment", "level")
