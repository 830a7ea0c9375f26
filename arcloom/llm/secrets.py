"""Secret scanning: candidates by pattern, false positives removed by a random forest, all in DataFrame functions."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_NAMES = r"(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)"
_ASSIGNED = rf"(?i:{_NAMES})[\"']?\s{{0,3}}[=:]\s{{0,3}}[\"']?"
#: What stands before a password in a URL, from the scheme's end on.
_URL = r"://[^\s:/@\"'?#]{0,64}+:"
_PROVIDERS = r"gh[pousr]_|sk_live_|xox[a-z]-|eyJ"
#: An assigned value; a password in a URL; a private key's first line; or a run of 16 or more of a key's characters that begins as providers' keys do or has a digit.
CANDIDATE = rf"{_ASSIGNED}[^\s\"']{{6,}}+|{_URL}[^\s/@\"']{{3,}}+(?=@)|-----BEGIN [A-Z ]{{0,20}}PRIVATE KEY(?: BLOCK)?-----|(?<![A-Za-z0-9+/_-])(?=AKIA|{_PROVIDERS}|[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{{16,}}+"
#: Fixed words; characters of a candidate that they cover speak for a placeholder or an identifier.
DICTIONARY = ("password", "passwd", "secret", "token", "example", "sample", "dummy", "test", "change", "your", "here", "replace", "redacted", "placeholder", "default", "admin", "user", "none", "null", "value", "config", "version", "release", "build", "image", "index", "page", "file", "name", "key", "api", "http", "www", "com", "the", "and", "abc", "123", "xxx", "000")
_GOOD_NEIGHBOURS = r"(?i)password|passwd|secret|token|credential|api.?key|access.?key|auth|bearer|private|login|aws|AKIA"
_BAD_NEIGHBOURS = r"(?i)\b(?:sha\d*|md5|commit|checksum|digest|uuid|guid|hash|revision|order|invoice|isbn|card|phone|tel|example|sample|e\.g|placeholder|tracking|id)\b"
_TEST_PATHS = r"(?i)test|example|sample|doc|mock|fixture|demo"
NEIGHBOURHOOD = 40
FEATURES = ("length", "transitions", "distinct", "digits", "upper", "hex", "only_digits", "dictionary", "provider", "uuid", "assigned", "good_neighbour", "bad_neighbour", "test_path")


@dataclass(frozen=True)
class Settings:
    """``findings`` labelled findings of each of the kinds below are made by rule; the forest is grown from them."""

    findings: int = 60
    trees: int = 9
    depth: int = 4
    least: int = 4
    accepts: float = 0.5


def candidates(docs: DataFrame, id_col: str, text_col: str, path_col: str | None) -> DataFrame:
    """``doc_id, start, value, before, after, path, assigned`` of each candidate; ``start`` is the value's character offset from 0."""
    text = F.col(text_col)
    path = F.coalesce(F.col(path_col).cast("string"), F.lit("")) if path_col else F.lit("")
    found = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), path.alias("path")).where(F.col("text").rlike(CANDIDATE))
    found = found.select("doc_id", "path", F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0)).alias("got"), F.split("text", CANDIDATE, -1).alias("gaps"))
    lengths = F.transform("got", lambda x: F.length(x).cast("long"))
    gaps = F.transform("gaps", lambda x: F.length(x).cast("long"))
    ends = F.aggregate(F.zip_with(gaps, lengths, lambda a, b: a + F.coalesce(b, F.lit(0))), F.array().cast("array<bigint>"), lambda acc, x: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) + x)))
    rows = found.select("doc_id", "path", "gaps", ends.alias("ends"), F.posexplode("got").alias("i", "match"))
    value = F.regexp_replace("match", f"^(?:{_ASSIGNED}|{_URL})", "")
    return rows.select(
        "doc_id", "path", value.alias("value"), (F.expr("ends[i]") - F.length(value)).alias("start"), F.expr(f"right(gaps[i], {NEIGHBOURHOOD})").alias("before"), F.expr(f"left(gaps[i + 1], {NEIGHBOURHOOD})").alias("after"),
        F.col("match").rlike(f"^(?:{_ASSIGNED}|{_URL})").alias("assigned"),
    )


def features(found: DataFrame) -> DataFrame:
    """The candidates with the columns ``FEATURES`` added, all doubles."""
    v = F.col("value")
    n = F.greatest(F.length(v), F.lit(1))
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(v, "[0-9]", "0"), "[a-z]", "a"), "[A-Z]", "A")
    words = "|".join(sorted(DICTIONARY, key=len, reverse=True))
    near = F.concat_ws(" ", F.col("before"), F.col("after"))
    of = {
        "length": F.length(v),
        "transitions": (F.length(F.regexp_replace(kinds, r"(.)\1+", "$1")) - 1) / n,
        "distinct": F.size(F.array_distinct(F.split(v, ""))) / n,
        "digits": F.length(F.regexp_replace(v, "[^0-9]", "")) / n,
        "upper": F.length(F.regexp_replace(v, "[^A-Z]", "")) / n,
        "hex": v.rlike("^[0-9a-fA-F]+$"),
        "only_digits": v.rlike(r"^[0-9_-]+$"),
        "dictionary": 1 - F.length(F.regexp_replace(F.lower(v), words, "")) / n,
        "provider": v.rlike(f"^(?:AKIA[0-9A-Z]{{16}}$|{_PROVIDERS}|-----BEGIN)"),
        "uuid": v.rlike("^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-"),
        "assigned": F.col("assigned"),
        "good_neighbour": near.rlike(_GOOD_NEIGHBOURS),
        "bad_neighbour": near.rlike(_BAD_NEIGHBOURS),
        "test_path": F.col("path").rlike(_TEST_PATHS),
    }
    return found.withColumns({k: x.cast("double") for k, x in of.items()})


def labelled_findings(spark: SparkSession, s: Settings) -> DataFrame:
    """Findings with known labels, as small texts ``(doc_id, text, path, y)``: each kind is a format filled from hashes of a number."""
    h, b = "sha2(concat(k, ':', id), 256)", "translate(base64(unhex(sha2(concat(k, '/', id), 512))), '+/=', 'xyz')"
    d = f"translate({h}, 'abcdef', '123456')"
    secrets = {
        "access key": f"concat('AKIA', upper(substr(translate({b}, '0189', 'QRST'), 1, 16)))",
        "password": f"concat('password=', substr({h}, 1, 12 + id % 20))",
        "token": f"concat('token = \"', substr({h}, 1, 40), '\"')",
        "forge token": f"concat('ghp_', substr({b}, 1, 36))",
        "payment key": f"concat('sk_live_', substr({b}, 1, 24))",
        "web token": f"concat('bearer eyJ', substr({b}, 1, 60))",
        "api key": f"concat('api_key: \"', substr({b}, 1, 32), '\"')",
        "secret": f"concat('secret=', substr({b}, 1, 20 + id % 12), '9')",
        "bare key": f"concat('credential ', substr({b}, 1, 40), '7')",
        "private key": "'-----BEGIN RSA PRIVATE KEY-----'",
        "private key block": "'-----BEGIN PGP PRIVATE KEY BLOCK-----'",
        "chat token": f"concat('xoxb-', translate(substr({b}, 1, 24), '0123456789', 'abcdefghij'))",
        "url password": f"concat('postgres://app:', substr({b}, 1, 10 + id % 10), '@db', id)",
    }
    others = {
        "card number": f"concat('4', substr({d}, 1, 15))",
        "revision": f"concat('commit ', substr({h}, 1, 40))",
        "checksum": f"concat('md5 ', substr({h}, 1, 32))",
        "bare digest": f"substr({h}, 1, 64)",
        "uuid": f"concat(substr({h}, 1, 8), '-', substr({h}, 9, 4), '-', substr({h}, 13, 4), '-', substr({h}, 17, 4), '-', substr({h}, 21, 12))",
        "placeholder": "concat('password=changeme', id)",
        "url placeholder": "concat('ftp://user:', if(id % 2 = 0, 'password', 'yourpassword'), '@host', id)",
        "your key": "concat('api_key=your_api_key_here_', id)",
        "example": "concat('token = \"example-token-000', id, '\"')",
        "redacted": "concat('secret=xxxxxxxxxxxx', id % 10)",
        "variable": "concat('password=${user_password_', id, '}')",
        "path": "concat('/usr/share/version-', id, '/images/page-', id)",
        "date": "concat('2024-01-', 10 + id % 20, 'T00-00-', 10 + id % 50)",
        "name": "concat('someLongIdentifierName', id)",
        "prose": "concat('retionthestandereding', id, 'a')",
        "test key": f"concat('AKIA', upper(substr(translate({b}, '0189', 'QRST'), 1, 9)), 'EXAMPLE')",
    }
    parts = [f"SELECT {y} AS y, '{k}' AS k, id, {x} AS finding FROM (SELECT id, '{k}' AS k FROM range({s.findings}))" for y, kinds in ((1, secrets), (0, others)) for k, x in kinds.items()]
    around = "concat('of the onre and when thed ', finding, ' is in that note')"
    return spark.sql(f"SELECT concat(k, id) AS doc_id, {around} AS text, if(id % 10 = 0, 'tests/example', 'src') AS path, y FROM ({' UNION ALL '.join(parts)})")


def grow(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, s: Settings, depth: int = 0) -> dict:
    """A tree: each split is the one of least Gini impurity among a random subset of the features."""
    p = float(y.mean())
    best = (p * (1 - p) * len(y) - 1e-9, None, None)
    if depth < s.depth and len(y) >= 2 * s.least:
        for f in rng.choice(x.shape[1], int(np.sqrt(x.shape[1])) + 1, replace=False):
            values = np.unique(x[:, f])
            cuts = (values[1:] + values[:-1]) / 2
            for cut in cuts if len(cuts) <= 16 else np.quantile(cuts, np.linspace(0, 1, 16)):
                left = x[:, f] <= cut
                n = int(left.sum())
                if s.least <= n <= len(y) - s.least:
                    a, b = y[left].mean(), y[~left].mean()
                    impurity = n * a * (1 - a) + (len(y) - n) * b * (1 - b)
                    if impurity < best[0]:
                        best = (impurity, int(f), float(cut))
    if best[1] is None:
        return {"p": p}
    left = x[:, best[1]] <= best[2]
    return {"f": best[1], "cut": best[2], "low": grow(x[left], y[left], rng, s, depth + 1), "high": grow(x[~left], y[~left], rng, s, depth + 1)}


def train(spark: SparkSession, s: Settings = Settings()) -> list[dict]:
    """A forest from the labelled findings; their features come from the same functions as those of any candidate."""
    findings = labelled_findings(spark, s)
    rows = features(candidates(findings, "doc_id", "text", "path")).join(findings.select("doc_id", "y"), "doc_id").select("doc_id", "y", *FEATURES).collect()
    rows = sorted(rows, key=lambda r: (r[0], r["length"]))
    x, y = np.array([[r[f] for f in FEATURES] for r in rows]), np.array([r["y"] for r in rows], float)
    rng = np.random.default_rng(0)
    return [grow(x[pick], y[pick], rng, s) for _ in range(s.trees) for pick in [rng.integers(0, len(y), len(y))]]


def probability(tree: dict) -> Column:
    if "p" in tree:
        return F.lit(tree["p"])
    return F.when(F.col(FEATURES[tree["f"]]) <= tree["cut"], probability(tree["low"])).otherwise(probability(tree["high"]))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source", settings: Settings = Settings(), keep_all: bool = False) -> DataFrame:
    """``doc_id, start, length, value, score`` of each secret found in whole texts, the score being the forest's mean.

    With ``keep_all`` the candidates that the forest takes for false positives come too. A null or empty text has
    none; a null path counts as empty; a text that holds a value twice has two findings; repeated rows give theirs each;
    an empty table gives no rows; other columns are ignored. There is no shuffle: each text is searched where it was read.
    """
    forest = train(docs.sparkSession, settings)
    path_col = path_col if path_col in docs.columns else None
    scored = features(candidates(docs, id_col, text_col, path_col)).withColumn("score", sum((probability(t) for t in forest), F.lit(0.0)) / len(forest))
    kept = scored if keep_all else scored.where(F.col("score") >= settings.accepts)
    return kept.select("doc_id", "start", F.length("value").alias("length"), "value", "score")
