"""URL verdicts: rules on host and path, and gradient-boosted trees on lexical features for the rest.

Rules are few and given. A rule fits its host and every subdomain if the path starts with its path;
of those that fit, the longest wins. URLs that a rule judges are the labelled ones: trees learn from
a sample of about TRAIN_ROWS of them, drawn row by row, with one row of each verdict at least, and
judge the URLs without rule. Features are length, depth, digit ratio, entropy, parameter counts and
statistics of the suffix; the statistics come from all labelled rows but the row itself, everything
else from the row. DataFrame functions only.

Defined results: a null url, or one without ://, has empty host and path and no rule, and its
features are those of the text; a null page_id stays null; repeated rows are repeated; if all
labelled rows have one verdict, so has every other URL, and without labelled rows the verdict is
allow; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillcheck.llm.common import written

TRAIN_ROWS = 20_000
TREES, DEPTH, SEED = 10, 4, 7
#: Weight of the overall block rate in a suffix's rate, in rows.
PRIOR = 20.0
#: (verdict, host and path)
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
LEXICAL = ("url_length", "host_length", "path_length", "depth", "labels", "digit_ratio", "entropy", "params", "hyphens", "suffix_length")
FEATURES = (*LEXICAL, "suffix_rate", "suffix_rows", "domain_rate", "domain_rows")

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_PARTS = r"(?s)^.*?://([^/?#]*+)([^?#]*+)"


def _url() -> Column:
    return F.coalesce(F.col("url").cast("string"), F.lit(""))


def with_parts(pages: DataFrame) -> DataFrame:
    """Adds host and path."""
    host = F.translate(F.regexp_extract(_url(), _PARTS, 1), _UPPER, _UPPER.lower())
    return pages.withColumn("host", host).withColumn("path", F.regexp_extract(_url(), _PARTS, 2))


def with_rule(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """Adds rule and ruled, the verdict of the longest rule that fits; both null if none does."""
    rule, ruled = F.lit(None).cast("string"), F.lit(None).cast("string")
    for verdict, text in sorted(rules, key=lambda r: len(r[1])):  # longer ones are asked first
        host, slash, path = text.partition("/")
        fits = ((F.col("host") == host) | F.endswith("host", F.lit(f".{host}"))) & F.startswith("path", F.lit(slash + path))
        rule, ruled = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(verdict)).otherwise(ruled)
    return pages.withColumn("rule", rule).withColumn("ruled", ruled)


def entropy(text: Column) -> Column:
    """Bits for each character."""
    size = F.length(text)
    share = lambda c: (size - F.length(F.replace(text, c, F.lit("")))) / size
    return F.aggregate(F.array_distinct(F.split(text, "")), F.lit(0.0), lambda a, c: a - F.when(c != "", share(c) * F.log2(share(c))).otherwise(0.0))


def with_lexical(pages: DataFrame) -> DataFrame:
    """Adds the lexical features, and suffix and domain: the last label and the last two of the host."""
    url, size = _url(), F.greatest(F.length(_url()), F.lit(1))
    query = F.regexp_extract(url, r"(?s)\?([^#]*+)", 1)
    features = {
        "url_length": F.length(url),
        "host_length": F.length("host"),
        "path_length": F.length("path"),
        "depth": F.regexp_count("path", F.lit("/[^/]")),
        "labels": F.size(F.split("host", r"\.")),
        "digit_ratio": F.regexp_count(url, F.lit("[0-9]")) / size,
        "entropy": F.when(F.length(url) > 0, entropy(url)).otherwise(0.0),
        "params": F.when(query == "", 0).otherwise(F.regexp_count(query, F.lit("&")) + 1),
        "hyphens": F.regexp_count("host", F.lit("-")),
        "suffix_length": F.length(F.substring_index("host", ".", -1)),
    }
    df = pages.withColumns({k: v.cast("double") for k, v in features.items()})
    return df.withColumns({"suffix": F.substring_index("host", ".", -1), "domain": F.substring_index("host", ".", -2)})


def with_rates(rows: DataFrame, key: str, overall: float) -> DataFrame:
    """Adds the smoothed block rate and the log count of a key among all other labelled rows."""
    seen = rows.where("ruled is not null").groupBy(key).agg(F.count("*").alias("_n"), F.count_if(F.col("ruled") == "block").alias("_blocked"))
    df = rows.join(seen, key, "left")
    n = F.coalesce("_n", F.lit(0)) - F.when(F.col("ruled").isNotNull(), 1).otherwise(0)
    blocked = F.coalesce("_blocked", F.lit(0)) - F.when(F.col("ruled") == "block", 1).otherwise(0)
    return df.withColumn(f"{key}_rate", (blocked + PRIOR * overall) / (n + PRIOR)).withColumn(f"{key}_rows", F.log1p(n.cast("double"))).drop("_n", "_blocked")


def judged(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """page_id, host, path, rule, verdict, and block_score, the model's probability of block (null where it was not asked)."""
    rows = with_lexical(with_rule(with_parts(pages.select("page_id", F.col("url").cast("string").alias("url"))), rules))
    part = 1 << 40
    rows = written(rows.withColumn("_draw", F.pmod(F.xxhash64("page_id", _url(), F.monotonically_increasing_id()), F.lit(part))), "url-rows")
    least = lambda v: F.coalesce(F.min(F.when(F.col("ruled") == v, F.col("_draw"))), F.lit(-1))
    n, blocked, *always = rows.where("ruled is not null").agg(F.count("*"), F.count_if(F.col("ruled") == "block"), least("block"), least("allow")).first()
    if not 0 < blocked < n:
        other = F.lit("block" if n and blocked == n else "allow")
        return rows.select("page_id", "host", "path", "rule", F.coalesce("ruled", other).alias("verdict"), F.lit(None).cast("double").alias("block_score"))
    rated = with_rates(with_rates(rows, "suffix", blocked / n), "domain", blocked / n)
    rated = written(VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rated).drop(*LEXICAL), "url-rated")
    drawn = (F.col("_draw") < min(part, part * train_rows // n)) | F.col("_draw").isin(always)
    sample = rated.where(F.col("ruled").isNotNull() & drawn).withColumn("label", (F.col("ruled") == "block").cast("double"))
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=SEED).fit(sample.select("features", "label"))
    scored = model.transform(rated)
    asked = F.col("ruled").isNull()
    verdict = F.when(~asked, F.col("ruled")).when(F.col("prediction") == 1.0, "block").otherwise("allow")
    score = F.when(asked, F.get(vector_to_array("probability"), F.lit(1)))
    return scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"), score.alias("block_score"))
