"""Content hashes, invariants, table comparison and the scan for sensitive text."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegate.functions.times import DAY, lit


def content_hash(rows: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row that identifies the multiset of rows, in any order.

    Each row is hashed from its columns' names and values, each with its length before it and nulls
    marked apart, so that different rows have different texts; sixty-bit slices of the hashes are summed.
    The slices add up in any order and before the shuffle, so the table is neither sorted nor sent anywhere.
    """
    names = sorted(columns or rows.columns)

    def field(name: str) -> Column:
        value = F.col(name).cast("string")
        marked = F.coalesce(F.concat(F.length(value).cast("string"), F.lit(":"), value), F.lit("-"))
        return F.concat(F.lit(f"{len(name)}:{name}="), marked)

    digest = F.sha2(F.concat(F.lit(""), *[field(c) for c in names]), 256)
    slices = [F.conv(F.substring(digest, 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)") for i in range(4)]
    return rows.select(*[s.alias(f"s{i}") for i, s in enumerate(slices)]).agg(
        F.count(F.lit(1)).alias("rows"),
        F.concat_ws("-", *[F.coalesce(F.sum(f"s{i}"), F.lit(0)).cast("string") for i in range(4)]).alias("digest"),
    )


def invariants(txns: DataFrame) -> DataFrame:
    """Number of rows that break each rule of the transactions table."""
    keys = txns.groupBy("txn_id").agg(F.count(F.lit(1)).alias("n"))
    repeated = keys.agg(F.coalesce(F.sum(F.col("n") - 1), lit(0)).alias("n")).scalar()
    rules = {
        "received_before_event": F.col("received_us") < F.col("event_us"),
        "label_not_after_event": F.col("label_us") <= F.col("event_us"),
        "amount_not_positive": F.col("amount_minor") <= 0,
        "flag_not_union": F.col("is_fraud") != (F.col("fraud_s1") | F.col("fraud_s2") | F.col("fraud_s3")),
    }
    counts = txns.agg(*[F.count_if(rule).alias(name) for name, rule in rules.items()])
    return counts.withColumn("repeated_ids", repeated)


def scenario_labels(rows: DataFrame, threshold: int, s2: str, s3: str) -> DataFrame:
    """Labels from the rules that make a transaction fraudulent."""
    s1 = F.col("amount_minor") > threshold
    return rows.withColumns({"fraud_s1": s1, "fraud_s2": F.col(s2), "fraud_s3": F.col(s3)}).withColumn(
        "is_fraud", F.col("fraud_s1") | F.col("fraud_s2") | F.col("fraud_s3")
    )


def label_available(event_us: Column, is_fraud: Column, delay_us: Column, maturity_us: int = 30 * DAY) -> Column:
    """Fraud is known after its delay, legitimacy after the maturity period."""
    return event_us + F.when(is_fraud, delay_us).otherwise(lit(maturity_us))


def cell_differences(left: DataFrame, right: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Per column: cells that differ as text, and those that differ as numbers."""
    a = left.select(key, *[F.col(c).alias(f"a_{c}") for c in columns])
    b = right.select(key, *[F.col(c).alias(f"b_{c}") for c in columns])
    both = a.join(b, key)
    counts = both.agg(
        *[F.count_if(~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}"))).alias(f"t_{c}") for c in columns],
        *[
            F.count_if(~F.col(f"a_{c}").try_cast("double").eqNullSafe(F.col(f"b_{c}").try_cast("double"))).alias(f"n_{c}")
            for c in columns
        ],
    )
    cells = [
        F.struct(F.lit(c).alias("column"), F.col(f"t_{c}").alias("text_differences"), F.col(f"n_{c}").alias("number_differences"))
        for c in columns
    ]
    return counts.select(F.inline(F.array(*cells)))


def difference_examples(left: DataFrame, right: DataFrame, key: str, column: str, limit: int = 2) -> DataFrame:
    """The first differing cells by key."""
    a, b = left.select(key, F.col(column).alias("left")), right.select(key, F.col(column).alias("right"))
    differing = a.join(b, key).filter(~F.col("left").eqNullSafe(F.col("right")))
    return differing.orderBy(key).limit(limit)


# What counts as sensitive, from the public formats of each kind: the folder of a user's files, addresses of
# mailboxes other than reserved ones, PEM headers, vendors' published token prefixes, the address ranges
# reserved for private networks, names of machines in a local network and the names that laptops get by default.
# Every pattern begins with a literal or where a run begins, and runs are possessive: a line is read once, however
# long it is. A category is looked for in a text only if one of its literals occurs there.
SENSITIVE = {
    "home_path": (("/home/", "/Users/", ":\\Users\\"), r"(?<![A-Za-z0-9])/(?:home|Users)/\w|[A-Za-z]:\\Users\\\w"),
    "github_noreply": (("@users.noreply.github.com",), r"(?<![0-9])[0-9]++\+[A-Za-z0-9-]++@users\.noreply\.github\.com(?![A-Za-z0-9.-]*[A-Za-z0-9])"),
    "private_key": (("-----BEGIN ",), r"-----BEGIN [A-Z ]*+(?<= PRIVATE KEY)-----"),
    "token": (
        ("AKIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "sk-", "xox", "eyJ"),
        r"(?<![\w-])(?:AKIA[A-Z0-9]{16}|gh[opsur]_[A-Za-z0-9]{30}|sk-[A-Za-z0-9]{20}|xox[abprs]-[A-Za-z0-9-]{10}|eyJ[\w-]{20,}+\.[\w-]{10})",
    ),
    "private_ip": (
        ("10.", "192.168.", "172."),
        r"(?<![0-9.])(?:10(?:\.[0-9]{1,3}){3}|192\.168(?:\.[0-9]{1,3}){2}|172\.(?:1[6-9]|2[0-9]|3[01])(?:\.[0-9]{1,3}){2})(?![0-9.])",
    ),
    "host_name": (
        (".local", ".lan", ".internal", "s-MacBook", "s-iMac", "s-Mac-mini"),
        r"[A-Za-z0-9-]\.(?:local|lan|internal)(?![A-Za-z0-9.-])|[A-Za-z]s-(?:MacBook|iMac|Mac-mini)",
    ),
}
#: A mailbox from the start of its run on.
EMAIL = r"(?<![A-Za-z0-9._%+-])[._%+-]*+([A-Za-z0-9][A-Za-z0-9._%+-]*+@[A-Za-z0-9-][A-Za-z0-9.-]*\.[A-Za-z]{2,}+)"
#: Mail domains that are reserved for examples, and addresses that have a category of their own.
RESERVED_MAIL = r"@(?:[A-Za-z0-9-]+\.)*example\.(?:com|net|org)$|@users\.noreply\.github\.com$"
#: A name, then a value of at least six marks; it counts if the name tells of a secret.
ASSIGNED = r"(?<!\w)(\w++) ?[=:] ?[\"']?[^\s\"']{6}"
SECRET_NAMES = ("password", "passwd", "secret", "api_key", "apikey", "token")
#: Names of files that hold secrets, state or logs.
FILE_NAME = r"(?:^|/)\.env$|\.(?:db|sqlite|log|pem|key)$"
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"


def _any_of(text: Column, words: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(word)) for word in words])


def sensitive_files(rows: DataFrame, key: str, path: str) -> DataFrame:
    """Keys of rows whose path names a file that should not be shared; null paths name none."""
    return rows.filter(F.col(path).rlike(FILE_NAME)).select(key, F.lit("sensitive_file").alias("category"))


def sensitive_lines(rows: DataFrame, key: str, text: str, terms: Sequence[str] = ()) -> DataFrame:
    """Per text and category, how many lines have a finding; the text itself is not repeated. Null texts have none."""
    whole = F.col("_text")

    def matching(pattern: str) -> Callable[[Column], Column]:
        return lambda line: line.rlike(pattern)

    def mailbox(line: Column) -> Column:
        return F.exists(F.regexp_extract_all(line, F.lit(EMAIL), F.lit(1)), lambda m: ~m.rlike(RESERVED_MAIL))

    def secret(line: Column) -> Column:
        names = F.regexp_extract_all(F.lower(line), F.lit(ASSIGNED), F.lit(1))
        return F.exists(names, lambda name: _any_of(name, SECRET_NAMES))

    categories = {name: (_any_of(whole, hints), matching(pattern)) for name, (hints, pattern) in SENSITIVE.items()}
    categories["email"] = F.contains(whole, F.lit("@")), mailbox
    categories["credential"] = _any_of(F.lower(whole), SECRET_NAMES), secret
    if terms:
        lowered = [term.lower() for term in terms]
        categories["personal_term"] = _any_of(F.lower(whole), lowered), lambda line: _any_of(F.lower(line), lowered)
    cells = [
        F.struct(
            F.lit(name).alias("category"),
            F.when(hint, F.size(F.filter("_lines", test))).otherwise(0).cast("bigint").alias("lines"),
        )
        for name, (hint, test) in categories.items()
    ]
    split = rows.select(key, F.col(text).alias("_text"), F.split(F.col(text), LINE_BREAK).alias("_lines"))
    return split.select(key, F.inline(F.array(*cells))).filter("lines > 0")
