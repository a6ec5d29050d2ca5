"""Secret scanning by Spark expressions alone.

One pattern finds the candidates: whole dotted runs of key-like characters with a digit, known key
formats, private-key blocks, and shorter or letter-only values that stand where a secret stands
(assigned to a secret's name, in an authorization header, in a URL).  A text is its candidates and
the gaps between them, so nothing has to be joined back: features, forest and redaction work
inside the row.

Formats, headers and URLs are sure.  The forest learns from labels that do not look at names or
assignments and decides about the rest; its trees are written as nested CASE expressions.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.session import materialize

LEAST = 16  # characters of a candidate that nothing points to
SHORT = 6  # characters of a candidate that stands where a secret stands
_C = "[A-Za-z0-9_+/-]"
_DOTTED = rf"(?:{_C}|\.(?={_C}))"
_START = rf"(?<!{_C})(?<!{_C}\.)"
_RUN = rf"{_C}++(?:\.{_C}++)*+(?:={{1,2}}(?![A-Za-z0-9\"'=]))?"
_FORMAT = (
    "(?:(?:AKIA|ASIA|ABIA|ACCA)[A-Z0-9]{16}(?![A-Za-z0-9])|gh[pousr]_[A-Za-z0-9]{30,}|github_pat_[A-Za-z0-9_]{22,}"
    "|glpat-[A-Za-z0-9_-]{20,}|xox[abeoprs]-[A-Za-z0-9-]{11,}|[sr]k_(?:live|test)_[A-Za-z0-9]{16,}"
    "|sk-[A-Za-z0-9_-]{20,}|AIza[A-Za-z0-9_-]{35}|ya29\\.[A-Za-z0-9_-]{20,}|npm_[A-Za-z0-9]{36}|hf_[A-Za-z0-9]{30,}"
    "|SG\\.[A-Za-z0-9_-]{16,}\\.[A-Za-z0-9_-]{16,}|eyJ[A-Za-z0-9_-]{6,}\\.[A-Za-z0-9_-]{6,}\\.[A-Za-z0-9_-]*)"
)
_PEM = (
    r"-----BEGIN [A-Z0-9 ]{0,40}PRIVATE KEY(?: BLOCK)?-----"
    r"(?:[A-Za-z0-9+/=\s:,.()\\\"'-]*?-----END [A-Z0-9 ]{0,40}PRIVATE KEY(?: BLOCK)?-----"
    r"|(?:(?:\s|\\[nr])*+[A-Za-z0-9+/=]{20,}+)*+)"
)
_PASSWORD = "passw(?:or)?d|passwd|passphrase|pwd"
_NAMES = rf"{_PASSWORD}|secret|token|api[ _-]?key|access[ _-]?key|private[ _-]?key|credential|auth(?:orization)?(?!or)"
_TO = "[A-Za-z0-9_-]{0,16}[\"'\\]]{0,2} {0,3}(?:=>|:=|[=:]) {0,3}"
_SCHEMES = "bearer|basic|token|apikey"
_AUTHORIZED = rf"(?i:authorization)[\"']?\s{{0,2}}[:=]\s{{0,2}}[\"']?(?i:{_SCHEMES})\s{{1,3}}"
_QUERY = "[?&](?i:access_token|refresh_token|client_secret|api_?key|key|sig|signature|auth|token|secret|password)="
_END = "[^\\s\"'`<>,;(){}\\[\\]\\\\.:]"
_VALUE = rf"[^\s\"'`<>,;(){{}}\[\]\\=:]{_END[:-3]}]{{{SHORT - 2},}}{_END}"
#: Where candidates stand, tried in this order at each place that no key-like character precedes;
#: the cheap guards come first.
_POINTED = "|".join(
    [
        rf"(?<=[\"'])(?<=(?i:{_PASSWORD}|secret){_TO}[\"'])[^\"'\r\n]{{{SHORT},}}+(?=[\"'])",
        rf"(?<=:)(?<=://[^\s/:@]{{0,64}}:)[^\s/@\"'<>]{{3,}}(?=@)",
        rf"(?<==)(?<={_QUERY})[^\s&\"'<>#]{{{SHORT},}}",
        rf"(?=\S{{{SHORT}}})(?:(?<=\s)(?<=(?i:{_SCHEMES})\s{{1,3}})(?<={_AUTHORIZED})[^\s\"',;<>]{{{SHORT},}}"
        rf"|(?<=\s)(?<=(?i:bearer)\s{{1,3}})[A-Za-z0-9._~+/-]{{{LEAST},}}={{0,2}}"
        rf"|(?<=[=:>][\"'` ]{{0,4}})(?<=(?i:{_NAMES}){_TO}[\"'`]?)(?!(?i:{_SCHEMES}|digest|negotiate)\s){_VALUE})",
    ]
)
_KEYS = (
    rf"{_START}(?=[A-Za-z0-9_+/.-]{{{LEAST}}})(?:(?=(?:[A-Za-z0-9_+/-]{{1,80}}[/.])?{_FORMAT})"
    rf"|(?={_DOTTED}{{{LEAST}}})(?=(?:[A-Za-z_+/-]|\.(?={_C}))*+[0-9])){_RUN}"
)
_FOUND = rf"(?<![A-Za-z0-9_+/])(?:{_PEM}|(?<=[=:>\"'`\s])(?:{_POINTED})|{_KEYS})"
_KEYWORD = r"(?i)(token|secret|passw|passphrase|pwd|api.?key|access.?key|private.?key|auth|credential|bearer)"
_ASSIGNED = r"[=:]\W{0,8}$"
_DIGEST = r"(?i)(?:\b(?:sha-?[0-9]{1,3}|md5|commit|revision|checksum|digest|integrity|etag|blob|tree)\W{0,6})$"
_TEST_PATH = r"(?i)(test|example|sample|doc|fixture)"
#: Pieces of ordinary words; what they cover of a candidate speaks against a secret.
_PIECES = "(tion|ing|the|and|ment|ent|for|her|ter|ver|con|com|pre|pro|ess|able|name|file|path|page)"
FEATURES = (
    "length", "digits", "upper", "lower", "marks", "letter_digit", "digit_letter", "case_changes",
    "distinct", "covered", "keyword", "assigned", "quoted", "test_path", "word_before", "digest_before",
)
TREES, DEPTH, SEED, TRAIN_ROWS = 20, 6, 5, 20_000
THRESHOLD = 0.5
MASK = "[SECRET]"


def gaps(text: Column) -> Column:
    """What stands before, between and behind the candidates: one more than these."""
    return F.split(F.coalesce(text, F.lit("")), _FOUND)


def values(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_FOUND), F.lit(0))


def _features(value: Column, before: Column, after: Column, path: Column) -> Column:
    n = F.length(value).cast("double")
    share = lambda pattern: F.regexp_count(value, F.lit(pattern)) / n
    flag = lambda condition: F.when(condition, 1.0).otherwise(0.0)
    covered = F.length(F.regexp_replace(F.lower(value), _PIECES, "")).cast("double")
    named = {
        "length": n,
        "digits": share("[0-9]"),
        "upper": share("[A-Z]"),
        "lower": share("[a-z]"),
        "marks": share("[_+/-]"),
        "letter_digit": share("[A-Za-z](?=[0-9])"),
        "digit_letter": share("[0-9](?=[A-Za-z])"),
        "case_changes": share("[a-z](?=[A-Z])|[A-Z](?=[a-z])"),
        "distinct": F.size(F.array_distinct(F.split(value, ""))) / n,
        "covered": 1.0 - covered / n,
        "keyword": flag(before.rlike(_KEYWORD)),
        "assigned": flag(before.rlike(_ASSIGNED)),
        "quoted": flag(before.rlike("[\"'`]$") & after.rlike("^[\"'`]")),
        "test_path": flag(path.rlike(_TEST_PATH)),
        "word_before": flag(before.rlike(r"\p{L}{2,}\W{1,3}$")),
        "digest_before": flag(before.rlike(_DIGEST)),
    }
    return F.array(*[F.coalesce(named[k], F.lit(0.0)) for k in FEATURES])


def with_candidates(df: DataFrame, text: str, path: Column, out: str = "candidates") -> DataFrame:
    """Append ``out``: an array of ``value, before, after, features``, in text order, and the gaps
    around them as ``__gaps``."""
    kept = df.withColumn("__gaps", gaps(F.col(f"`{text}`"))).withColumn("__path", path)
    kept = kept.withColumn("__values", values(F.col(f"`{text}`")))
    at = lambda name, i: F.right(F.coalesce(F.get(F.col(name), i), F.lit("")), F.lit(48))
    kept = kept.withColumn(
        out,
        F.transform(
            "__values",
            lambda v, i: F.struct(
                v.alias("value"),
                F.right(F.concat(at("__gaps", i - 1), at("__values", i - 1), at("__gaps", i)), F.lit(48)).alias("before"),
                F.left(F.get(F.col("__gaps"), i + 1), F.lit(8)).alias("after"),
            ),
        ),
    )
    return kept.withColumn(
        out,
        F.transform(
            out,
            lambda c: F.struct(
                c["value"].alias("value"), c["before"].alias("before"), c["after"].alias("after"),
                _features(c["value"], c["before"], c["after"], F.col("__path")).alias("features"),
            ),
        ),
    ).drop("__path", "__values")


_HEADER = rf"(?:{_AUTHORIZED}|(?i:\bbearer)\s{{1,3}}|(?i:\bx-[a-z-]{{0,20}}(?:key|token))[\"']?:\s{{0,2}}[\"']?)$"
_REFERENCE = r"(?:[$%]\{|\{\{\s?|\$\()$"  # a variable's name follows
_UUID = "^[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$"
_HOST = r"^(?:https?:)?/{0,2}(?:[A-Za-z][a-z0-9-]{0,20}\.)+[a-z]{2,6}(?:/[a-z0-9_./-]*)?$"
_PLACEHOLDER = (
    r"(?i)(?:example|changeme|change_me|placeholder|redacted|your[_-]|x{6}|\*{4}|\.{3}|\$\{|%\(|^\$[A-Z_]+$|getenv|environ|://)"
    r"|^(?:string|required|optional|integer|boolean|undefined|process\..*|config\..*|self\..*)$"
)


def sure(value: Column, before: Column, after: Column) -> Column:
    """A known key format, or a value in an authorization header or in a URL's place of secrets."""
    url = (before.rlike(r"://[^\s/:@]{0,40}:$") & after.startswith("@")) | before.rlike(f"{_QUERY}$")
    known = value.rlike("^-----BEGIN ") | value.rlike(f"(?:^|[/.=]){_FORMAT}")
    header = before.rlike(_HEADER) & (before.rlike(f"{_AUTHORIZED}$") | value.rlike("[0-9]"))
    return (known | url | header) & ~value.rlike(_PLACEHOLDER)


def weak_label(value: Column, before: Column, after: Column | None = None) -> Column:
    """A label where none is given, from the value's form and places other than names and
    assignments: 1 if :func:`sure` or random in looks, 0 for numbers, digests, hosts,
    placeholders and values of few characters, null if unclear."""
    n = F.length(value).cast("double")
    share = lambda x: (n - F.length(F.replace(value, x, F.lit("")))) / n
    bits = F.aggregate(
        F.transform(F.array_distinct(F.split(value, "")), lambda x: F.when(x == "", 0.0).otherwise(-share(x) * F.log2(share(x)))),
        F.lit(0.0), lambda a, x: a + x,
    )
    changes = F.regexp_count(
        value, F.lit("[A-Za-z](?=[0-9])|[0-9](?=[A-Za-z])|[a-z](?=[A-Z])|[A-Z](?=[a-z])")
    ) / n
    plain = value.rlike(r"^[0-9_+/.:-]*$") | value.rlike(_HOST) | value.rlike(_PLACEHOLDER)
    mixed = value.rlike("[A-Za-z]") & value.rlike("[0-9]") & value.rlike("[A-Za-z0-9]{20}")
    return (
        F.when(sure(value, before, F.lit("") if after is None else after), 1.0)
        .when(plain | before.rlike(_DIGEST) | before.rlike(_REFERENCE) | ((n >= LEAST) & (bits < 2.5)), 0.0)
        .when(value.rlike(_UUID), None)
        .when(mixed & (bits >= 3.0) & (changes >= 0.2), 1.0)
    )


def handed(value: Column, before: Column) -> Column:
    """A value that stands directly behind a secret's name and ``=`` or ``:``; numbers only behind
    a password's."""
    to = lambda names: before.rlike(rf"(?i:{names}){_TO}[\"'`]?$")
    number = value.rlike(r"^[0-9_+/.:-]*$")
    return F.when(number, to(_PASSWORD)).otherwise(to(_NAMES)) & ~value.rlike(_PLACEHOLDER)


class Forest:
    """Trees as CASE expressions over an array of features.  Without trees the label is the score,
    and unclear candidates need a secret's name and an assignment."""

    def __init__(self, trees: list[str]):
        self.trees = trees

    def score(self, features: Column, label: Column) -> Column:
        if not self.trees:
            at = {k: features[FEATURES.index(k)] for k in ("keyword", "assigned")}
            return F.coalesce(label, F.least(at["keyword"], at["assigned"]))
        votes = [_case(t, features) for t in self.trees]
        total = votes[0]
        for v in votes[1:]:
            total = total + v
        return total / len(votes)


def _case(tree, features: Column) -> Column:
    if isinstance(tree, float):
        return F.lit(tree)
    index, threshold, left, right = tree
    return F.when(features[index] <= threshold, _case(left, features)).otherwise(_case(right, features))


def _nested(node):
    """A tree of the fitted model as (feature, threshold, left, right) or the leaf's share of 1."""
    if node.numDescendants() == 0:
        stats = list(node.impurityStats().stats())
        return float(stats[1] / sum(stats)) if len(stats) > 1 and sum(stats) else 0.0
    split = node.split()
    left, right = _nested(node.leftChild()), _nested(node.rightChild())
    return (int(split.featureIndex()), float(split.threshold()), left, right)


def train_forest(findings: DataFrame) -> Forest:
    """A forest from ``features, label`` rows.

    Learns from at most ``TRAIN_ROWS`` rows, those with the smallest hashes of their features, so
    the sample does not depend on the order of rows.  Without both labels there are no trees.
    """
    rows = findings.filter(F.col("label").isin(0.0, 1.0)).select("features", F.col("label").cast("double"))
    rows = rows.orderBy(F.xxhash64("features", F.lit(SEED)), "label").limit(TRAIN_ROWS)
    rows = materialize(rows.coalesce(1), "labelled-findings")
    if rows.select("label").distinct().count() < 2:
        return Forest([])
    wide = rows.select("label", *[F.col("features")[i].alias(k) for i, k in enumerate(FEATURES)])
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="vector").transform(wide)
    fitted = RandomForestClassifier(
        featuresCol="vector", labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=SEED, bootstrap=False
    ).fit(vectors)
    return Forest([_nested(tree._java_obj.rootNode()) for tree in fitted.trees])


def scan_secrets(
    df: DataFrame, text: str = "text", path: str | None = "source", labelled: DataFrame | None = None
) -> DataFrame:
    """Append ``findings`` (``value, before, after, score, secret``, in text order) and
    ``redacted``, the text with each secret's value replaced by ``[SECRET]``.

    ``labelled`` has ``features, label`` rows; without it the findings of ``df`` teach by
    :func:`weak_label`; unclear ones do not teach.  Null texts have no findings and stay null; a null path is no test path.
    Rows, also repeated ones, and other columns pass through; ``findings`` and ``redacted`` are
    replaced where they stand.
    """
    where = F.coalesce(F.col(f"`{path}`"), F.lit("")) if path in df.columns else F.lit("")
    own = df.drop("findings", "redacted")
    if labelled is None:
        seen = with_candidates(own.select(text, *([path] if path in df.columns else [])), text, where)
        each = seen.select(F.explode("candidates").alias("c"))
        labelled = each.select(
            F.col("c.features").alias("features"),
            weak_label(F.col("c.value"), F.col("c.before"), F.col("c.after")).alias("label"),
        )
    forest = train_forest(labelled)
    seen = with_candidates(own, text, where)
    score = lambda c: forest.score(c["features"], weak_label(c["value"], c["before"], c["after"]))
    scored = F.transform(
        "candidates",
        lambda c: F.struct(
            c["value"].alias("value"), c["before"].alias("before"), c["after"].alias("after"),
            F.when(sure(c["value"], c["before"], c["after"]), 1.0)
            .when(handed(c["value"], c["before"]), F.greatest(F.lit(THRESHOLD), score(c)))
            .when(c["before"].rlike(_DIGEST) | c["before"].rlike(_REFERENCE), 0.0)
            .otherwise(score(c)).alias("score"),
        ),
    )
    seen = seen.withColumn("candidates", scored)
    seen = seen.withColumn(
        "findings",
        F.transform("candidates", lambda c: c.withField("secret", c["score"] >= THRESHOLD)),
    )
    masked = F.transform("findings", lambda c: F.when(c["secret"], F.lit(MASK)).otherwise(c["value"]))
    parts = F.zip_with("__gaps", masked, lambda gap, value: F.concat(gap, F.coalesce(value, F.lit(""))))
    seen = seen.withColumn(
        "redacted",
        F.when(F.exists("findings", lambda c: c["secret"]), F.array_join(parts, "")).otherwise(F.col(f"`{text}`")),
    )
    return seen.select(*[F.col(f"`{c}`") for c in own.columns], "findings", "redacted")
