"""Word lists, patterns, formats and tolerances that the rules are defined by.

Patterns are Java regular expressions; (?U) makes classes and word boundaries Unicode-aware, (?i) folds case.
"""

NBSP = "\u00a0"

UNITS = (
    "мм", "см", "м", "км", "г", "кг", "мг", "с", "мин", "ч", "л", "мл",
    "К", "K", "Вт", "кВт", "Дж", "кДж", "Па", "кПа", "МПа", "В", "кВ",
    "А", "Гц", "кГц", "МГц", "моль", "Н", "пт",
)
_UNIT = "|".join(sorted(UNITS, key=len, reverse=True))

#: (parameter, pattern, severity): a paragraph whose text has a match breaks the rule; several rows of a parameter are asked in order.
TYPOGRAPHY = (
    ("repeated_spaces", r" {2,}", "error"),
    ("repeated_tabs", r"\t{2,}", "warning"),
    ("spaces_near_punctuation", r"(?U)\s+([.,;:!?])", "error"),
    ("spaces_inside_brackets_quotes", r"(?U)[(\[{«„]\s+", "error"),
    ("spaces_inside_brackets_quotes", r"(?U)\s+[)\]}»“]", "error"),
    ("number_letter_no_space", r"(?iU)\b(рис\.|табл\.|п\.|ст\.|§|№)\s+(\d+)\s+([а-яa-z])\b", "error"),
    ("nbsp_after_abbreviations", r"(?U)\b(г|ул|пер|дер|пос|с|р|д|к|стр|кв|ч|гл|ст|п|пп)\. (?=\S)", "error"),
    ("nbsp_between_initials", r"(?U)\b[А-ЯЁA-Z]\. [А-ЯЁA-Z]\.(?: [А-ЯЁA-Z][A-Za-zА-ЯЁа-яё-]+)?", "error"),
    ("nbsp_after_number_sign", r"(?U)(№) (\d+)", "error"),
    ("nbsp_after_paragraph_sign", r"(?U)(§) (\d+)", "error"),
    ("nbsp_after_figure_table_reference", r"(?iU)\b(рис\.|рисунок|табл\.|таблица) (\d+(?:\.\d+)*)", "error"),
    ("nbsp_between_number_and_unit", rf"(?iU)\b(\d+(?:[,.]\d+)?) ({_UNIT}|%|‰)\b", "error"),
    ("math_operator_nbsp", rf"(?U)(?<=[A-Za-z0-9])(?: |{NBSP})?([+±×·=])(?: |{NBSP})?(?=[A-Za-z0-9])|(?<=\d)(?: |{NBSP})?:(?: |{NBSP})?(?=\d)", "error"),
    ("slash_without_spaces", r"(?U)(?<=\w)\s+/\s+(?=\w)", "error"),
    ("wrong_multiplication_symbols", r"(?U)(?<=\d)\s*[*xX]\s*(?=\d|[a-zA-Zа-яА-Я])", "error"),
    ("hyphen_instead_of_minus", r"(?U)(?:(?<=[=+\u00a0 ])-\d|(?<=\w)\s-\s(?=\w))", "warning"),
    ("decimal_separator_comma", r"(?U)(?<![\w.])\d+\.\d+\b(?!\.\d)", "error"),
    ("degree_symbol", r"(?U)\b\d+(?:[,.]\d+)?\s*[oO](?=\s*(?:C|F|С|К|K)\b)", "error"),
    ("multiplication_symbol", r"(?U)(?<=\d)\s*[*xX]\s*(?=\d|[a-zA-Zа-яА-Я])", "error"),
    ("minus_symbol", r"(?U)(?:(?<=[=+\u00a0 ])-\d|(?<=\w)\s-\s(?=\w))", "warning"),
    ("numeric_range_dash", r"(?U)\b\d+\s*-\s*\d+\b", "error"),
    ("numeric_range_dash", r"(?U)\b\d+\s+[–—]\s+\d+\b", "error"),
    ("numeric_range_dash", r"(?U)[-−]\d+\s*[–—-]\s*[+-]?\d+", "warning"),
    ("unit_nbsp", rf"(?iU)\b(\d+(?:[,.]\d+)?) ({_UNIT}|%|‰)\b", "error"),
    ("temperature_nbsp", r"(?U)\b\d+(?:[,.]\d+)?°[CFС]\b", "error"),
    ("temperature_nbsp", r"(?U)\b\d+(?:[,.]\d+)?\s+°(?![CFС])", "error"),
    ("percent_nbsp", r"(?U)\b\d+(?:[,.]\d+)? [%‰]", "error"),
    ("dimension_operator_spacing", r"(?U)\b[А-Яа-яA-Za-z]+[·×][А-Яа-яA-Za-z]+", "error"),
    ("dimension_operator_spacing", r"(?U)(?<!\w)[+±×]\s+\d", "error"),
    ("no_dot_after_units", rf"(?iU)\b\d+(?:[,.]\d+)?(?: |{NBSP})({_UNIT})\.(?=\s+[а-яa-z])", "error"),
    ("variable_unit_comma", r"(?U)\b([A-Za-zА-Яа-я])\s+(Дж|Вт|Па|Н|м|см|кг|г)\b", "error"),
    ("variable_unit_comma", r"(?iU)\b(ln|log)\s+\w+\s+(?!\[)", "error"),
    ("unit_only_after_last_number", r"(?U)\b\d+\s*(мм|см|м|г|кг|Вт|В)\s*,\s*\d+\s*\1", "warning"),
    ("digit_grouping_nbsp", r"(?U)(?<![\w.])[-−]?\d{5,}(?![\w.])", "error"),
    ("hyphen_spacing", r"(?U)\w\s-\s\w", "error"),
    ("manual_hyphenation_forbidden", r"(?U)\w-\s*$", "warning"),
    ("dash_spacing", r"(?U)\w—\w", "error"),
    ("hyphen_instead_of_dash", r"(?U)\w\s-\s\w", "error"),
    ("nested_quotes", r"«[^»]*«[^»]+»[^»]*»", "error"),
    ("number_sign_symbol", r"(?iU)\b(N|No|#)\s*\d+", "error"),
    ("number_sign_nbsp", r"(?U)(№) (\d+)", "error"),
    ("parentheses_not_slash", r"(?U)\b\w+/[^/\s]+/", "error"),
    ("citation_omission_format", r"(?U)(\[\s*\.{3}\s*\]|…|\[\s*…\s*\])", "error"),
    ("music_terms_typography", r"(?U)\b[A-Ha-h]-?(?:dur|moll)\b", "warning"),
)
STRAIGHT_QUOTES = r'"[^"]+"'
SQUARE_BRACKETS = r"\[[^\]]+\]"
REFERENCE_BRACKETS = r"(?iU)^\[\d+(?:,\s*с\.\s*\d+)?(?:;\s*\d+)*\]$"
URL, EMAIL = r"(?i)https?://|www\.", r"(?U)\b[\w.+-]+@[\w.-]+\.\w+\b"
STANDARD_NUMBER = r"(?iU)ГОСТ\s+Р?\s*\d+(?:\.\d+)*[-–]\d{4}"
PHONE = r"(?U)(\+7|8)?\s?\(?\d{3}\)?[\s-]?\d{3}[\s-]?\d{2}[\s-]?\d{2}"
VALID_PHONE = r"(?U)^(?:((\+7|8)\s)?\d{3}\s\d{3}-\d{2}-\d{2})$"
#: Parameters whose findings count as values: a version, a standard's number, an address or a four-digit number is no finding.
VALUE_PARAMETERS = (
    "math_operator_nbsp", "slash_without_spaces", "wrong_multiplication_symbols", "hyphen_instead_of_minus", "decimal_separator_comma", "degree_symbol", "multiplication_symbol", "minus_symbol", "numeric_range_dash", "unit_nbsp", "temperature_nbsp", "percent_nbsp", "dimension_operator_spacing", "no_dot_after_units", "variable_unit_comma", "unit_only_after_last_number", "digit_grouping_nbsp",
)
EQUATION_NUMBER = r"(?U)\((\d+(?:\.\d+)*)\)\s*$"
EQUATION_REFERENCE = r"(?iU)\b(?:формул[аеуы]|уравнени[ея]|см\.)\s*\((\d+(?:\.\d+)*)\)"
SCIENTIFIC_TEN, SCIENTIFIC_E = r"(?U)\d+,\d+\s*[·×]\s*10", r"(?U)\d+,\d+[Ee][+-]?\d+"
VARIABLE = r"(?U)\b[a-zA-Z]\b"
FUNCTION = r"(?iU)\b(sin|cos|tg|tan|ln|log|exp|grad)\b"
CHEMICAL = r"(?U)\b([A-Z][a-z]?\d*){2,}\b"

HEADING_NUMBER = r"(?Us)^(\d+(?:\.\d+)*)(?:\.\s*|\s+)(.+)$"
APPENDIX_HEADING = r"(?iU)^приложение\s+[а-яёa-z](?:\.|\s|$)"
CAPTION = r"(?iU)^(Рис\.|Рисунок|Табл\.|Таблица)\s+(\d+(?:\.\d+)*)([.—-])?\s*(.*)$"
LIST_STYLES = ("list", "список", "перечень", "bullet", "numbered")
STRUCTURAL_HEADINGS = (
    "содержание", "оглавление", "введение", "заключение", "вывод", "выводы", "список литературы", "список источников",
    "список использованной литературы", "список использованных источников", "библиографический список", "библиография", "приложение", "приложения",
)
REFERENCE_HEADINGS = ("список литературы", "список источников", "список использованной литературы", "список использованных источников", "библиографический список", "библиография")
ROLE_LEVELS = {"structural heading": 1, "subsection heading": 2, "point heading": 3, "appendix heading": 1, "section heading": 1}
#: (type, pattern), asked in order
LIST_MARKERS = (
    ("dash", r"(?U)^[—–]\s+\S"),
    ("hyphen", r"(?U)^-\s+\S"),
    ("bullet", r"(?U)^[•▪▫‣]\s+\S"),
    ("number_bracket", r"(?U)^\d+\)\s+\S"),
    ("number_dot", r"(?U)^\d+\.\s+\S"),
    ("letter_bracket", r"(?iU)^[а-я]\)\s+\S"),
    ("letter_dot", r"(?iU)^[а-я]\.\s+\S"),
)
NUMBERED_MARKERS = ("number_bracket", "number_dot", "letter_bracket", "letter_dot")
LIST_MARKER_START = r"(?U)^\s*(?:[-–—•▪▫‣]|\d+[).]|[а-яА-ЯёЁ][).])\s+"
TITLE_PAGE_WORDS = (
    "министерство", "университет", "институт", "факультет", "кафедра", "выпускная квалификационная работа", "курсовая работа", "лабораторная работа", "отчет", "отчёт",
    "реферат", "тема", "выполнил", "выполнила", "студент", "обучающийся", "руководитель", "преподаватель", "проверил", "проверила",
)
TITLE_PAGE_STOPS = ("содержание", "оглавление", "введение", "заключение")
TITLE_PAGE_YEAR, TITLE_PAGE_CITY = r"(?U)\b20\d{2}\b", r"(?U)\b(москва|санкт-петербург|спб|казань|новосибирск)\b"

#: Page formats in centimetres, portrait.
PAGE_FORMATS = (("A0", 84.1, 118.9), ("A1", 59.4, 84.1), ("A2", 42.0, 59.4), ("A3", 29.7, 42.0), ("A4", 21.0, 29.7), ("A5", 14.8, 21.0), ("A6", 10.5, 14.8))
PAGE_TOLERANCE_CM = 0.2
TOLERANCES = {"cm": 0.05, "pt": 0.5, "ratio": 0.05, "lines": 0.05}
OTHER_TOLERANCE = 0.02
SUPPRESSED_PARAMETERS = ("empty_paragraph_between_content", "empty_paragraph_around_heading", "additional_spacing_limit", "manual_breaks_forbidden")
