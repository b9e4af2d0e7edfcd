"""A deterministic generator of alert records: every draw is a hash of the seed, the row and the field's name.

A family is a place where alerts arise crossed with what is seen there, so families that share either one look
alike in half of their fields. One further family is kept out of all rows before the test part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import portable_hash

#: Places: name, process, port, category.
PLACES = (
    ("mailroom", "mailgate", 587, "messaging"),
    ("ledger", "ledgerd", 5432, "storage"),
    ("storefront", "frontproxy", 8443, "web"),
    ("gatehouse", "doorctl", 9100, "premises"),
    ("workshop", "buildagent", 8081, "engineering"),
)
#: What is seen: name, words of the record, technique, usual verdict.
SIGHTINGS = (
    ("flood", "requests far above the hourly limit", "T1499", "TRUE_POSITIVE"),
    ("drift", "settings differ from the stored baseline", "T1562", "FALSE_POSITIVE"),
    ("replay", "one token presented from two networks", "T1550", "TRUE_POSITIVE"),
    ("review", "planned review opened many records", "T1213", "BENIGN"),
)
#: The family of the test part alone, in the same fields.
HELD_OUT = ("vault_export", "vaultd", 8200, "secrets", "sealed keys copied to a removable disk", "T1552", "TRUE_POSITIVE")
VERDICTS = ("TRUE_POSITIVE", "FALSE_POSITIVE", "BENIGN")
#: Minutes between rows; rows in a thousand with a random verdict, and with a missing value in each of five fields.
MINUTES, NOISE, NULLS = 7, 70, 35
MISSING_FIELDS = ("username", "source_port", "destination_ip", "process_command_line", "mitre_technique")


def families() -> list[tuple]:
    """``family, process, port, category, words, technique, verdict`` of every known family, then of the held-out one."""
    known = [(f"{place}_{sight}", process, port, category, words, technique, verdict) for place, process, port, category in PLACES for sight, words, technique, verdict in SIGHTINGS]
    return [*known, HELD_OUT]


def alerts(spark: SparkSession, size: int = 5000, seed: int = 42, start: str = "2026-01-01 00:00:00", train_and_validation: float = 0.85, unseen_fraction: float = 0.3, ids: DataFrame | None = None) -> DataFrame:
    """Alert rows in time order; the held-out family occurs in the last part only.

    Rows are numbered from 0; ``ids`` gives other rows (distinct whole numbers ``id``, of which their number is the size).
    """
    size = size if ids is None else ids.count()
    if size < 100:
        raise ValueError("at least 100 rows")
    i, kinds = F.col("id"), families()

    def draw(field: str, n: int) -> Column:
        return portable_hash(F.concat_ws("|", F.lit(str(seed)), F.lit(field), i.cast("string")), n)

    def of_family(k: int) -> Column:
        return F.element_at(F.array(*[F.lit(f[k]) for f in kinds]), (F.col("kind") + 1).cast("int"))

    text = lambda x: x.cast("string")
    late = (i >= int(size * train_and_validation)) & (draw("unseen", 1000) < round(1000 * unseen_fraction))
    rows = (spark.range(size) if ids is None else ids.select("id")).withColumn("unseen", late).withColumn("kind", F.when(late, F.lit(len(kinds) - 1).cast("long")).otherwise(draw("family", len(kinds) - 1)))
    # Four crews of one network each share a place; a crew's people and machines are numbered within it.
    crew, person = F.pmod(F.col("kind") + draw("crew", 3), F.lit(4)), draw("person", 30)
    true = of_family(6) == "TRUE_POSITIVE"
    fields = {
        "timestamp": F.timestamp_seconds(F.unix_timestamp(F.lit(start).cast("timestamp")) + i * (60 * MINUTES) + draw("second", 180)),
        "alert_id": F.format_string("Q%08d", i),
        "alert_name": F.concat(F.initcap(of_family(3)), F.lit(" signal")),
        "rule_id": F.concat(of_family(3), F.lit("/"), of_family(5)),
        "severity": F.element_at(F.array(*map(F.lit, ("low", "medium", "high"))), (F.least(F.lit(2), draw("severity", 3) + F.when(true, 1).otherwise(0)) + 1).cast("int")),
        "category": of_family(3),
        "mitre_tactic": F.concat(F.lit("tactic of "), of_family(5)),
        "mitre_technique": of_family(5),
        "hostname": F.concat(of_family(1), F.lit("-"), text(crew), F.lit("-"), text(draw("machine", 20))),
        "username": F.when(draw("robot", 5) == 0, F.concat(F.lit("robot."), of_family(1))).otherwise(F.concat(F.lit("crew"), text(crew), F.lit("."), text(person))),
        "source_ip": F.concat(F.lit("172.20."), text(crew), F.lit("."), text(person + 10)),
        "destination_ip": F.concat(F.lit("172.24."), text(F.col("kind")), F.lit("."), text(draw("machine", 20) + 1)),
        "source_port": 32768 + draw("port", 28000),
        "destination_port": F.when(draw("odd_port", 10) < 8, of_family(2)).otherwise((1024 + draw("other_port", 500)).cast("int")),
        "process_name": of_family(1),
        "process_command_line": F.concat(of_family(1), F.lit(": "), of_family(4), F.lit(", case "), text(draw("case", 40))),
        "action": F.when(true & (draw("action", 2) == 0), "blocked").when(draw("action", 4) < 3, "detected").otherwise("allowed"),
        "verdict": F.when(draw("noise", 1000) < NOISE, F.element_at(F.array(*map(F.lit, VERDICTS)), (draw("verdict", 3) + 1).cast("int"))).otherwise(of_family(6)),
        "family": of_family(0),
        "is_unseen": F.col("unseen"),
    }
    for name in MISSING_FIELDS:
        fields[name] = F.when(draw(f"missing {name}", 1000) >= NULLS, fields[name])
    return rows.select(*[x.alias(name) for name, x in fields.items()])


def manifest(rows: DataFrame, digests: DataFrame | None = None) -> dict:
    """What a generated file holds: rows, families, verdicts, unseen rows; and of its files the sizes and SHA-256."""
    counts = lambda c: {r[c]: r["count"] for r in rows.groupBy(c).count().collect()}
    out = {"families": counts("family"), "verdicts": counts("verdict"), "unseen": counts("is_unseen").get(True, 0)}
    out["rows"] = sum(out["families"].values())
    if digests is not None:
        out["files"] = [{"name": r["path"].rpartition("/")[2], "bytes": r["bytes"], "sha256": r["sha256"]} for r in digests.orderBy("path").collect()]
    return out
