"""Provider replies carried back: every row's way through the rounds, against a plain loop over the rows of each round."""

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import billing

KEY = ["casillero", "source_file", "id_ingreso"]
MISMATCH = "invalid_total_payments: the total invoice calculated is 9.99"


def plain(rows, start, limit, reserved, reply, rounds):
    """rows: sorted (key, value); reply(key, attempt, number) -> text or None. The same rules, row by row."""
    free = [n for n in range(start, limit + 1) if n not in reserved]
    state = [dict(key=k, value=v, at=i, attempts=0, corrected=False) for i, (k, v) in enumerate(rows)]
    top, spare, out = len(rows), [], {}
    for _ in range(rounds):
        if not state:
            break
        again, refused, replied = [], [], False
        for s in state:
            if s["at"] >= len(free):
                out[s["key"]] = (None, s["value"], s["attempts"], "rejected", "limit_reached")
                continue
            text = reply(s["key"], s["attempts"] + 1, free[s["at"]])
            if text is None:
                s["corrected"] = False
                again.append(s)
                continue
            replied = True
            s["attempts"] += 1
            if text == "ok":
                out[s["key"]] = (free[s["at"]], s["value"], s["attempts"], "issued", "ok")
            elif "already" in text:
                refused.append(s | {"corrected": False})
            elif "limit" in text or "service" in text:
                again.append(s | {"corrected": False})
            elif "calculated is" in text and not s["corrected"]:
                again.append(s | {"corrected": True, "value": 9.99})
            else:
                spare.append(s["at"])
                out[s["key"]] = (None, s["value"], s["attempts"], "rejected", "total_mismatch" if "invalid_total" in text else "error")
        spare.sort()
        for s in sorted(refused, key=lambda s: s["at"]):
            if spare:
                s["at"] = spare.pop(0)
            else:
                s["at"], top = top, top + 1
            again.append(s)
        state = again
        if not replied:
            break
    for s in state:
        out[s["key"]] = (None, s["value"], s["attempts"], "pending", "no_reply") if s["attempts"] < rounds else \
            (None, s["value"], s["attempts"], "rejected", "too_many_attempts")
    return out


def run(spark, rows, register, limit, reserved, log, rounds=20):
    """log: {(id, attempt): reply}; attempts not named are answered 'ok'."""
    valid = spark.createDataFrame([("1", "f", k, Decimal(str(v))) for k, v in rows], "casillero string, source_file string, id_ingreso string, value decimal(38,2)")
    reg = spark.createDataFrame([(str(n), str(n)) for n in register], "consecutive string, number string")
    taken = spark.createDataFrame([(n,) for n in reserved], "number bigint")
    table = spark.createDataFrame([(k, a, r) for (k, a), r in log.items()], "id_ingreso string, attempt int, _reply string").withColumn("_has", F.lit(True))

    def ask(proposals):
        j = proposals.join(table, ["id_ingreso", "attempt"], "left")
        return j.withColumn("reply", F.when(F.col("_has"), F.col("_reply")).otherwise("ok")).drop("_reply", "_has")
    got = billing.retry_rounds(valid, reg, taken, limit, ask, rounds)
    return {r.id_ingreso: (r.number, float(r.value), r.attempts, r.outcome, r.reason) for r in got.collect()}


def check(spark, rows, register, limit, reserved, log, rounds=20):
    start = max(register) + 1 if register else limit + 1
    want = plain(sorted(rows), start, limit, set(reserved), lambda k, a, n: log.get((k, a), "ok"), rounds)
    got = run(spark, rows, register, limit, reserved, log, rounds)
    assert got == want
    numbers = [v[0] for v in got.values() if v[0]]
    assert len(numbers) == len(set(numbers))
    return got


def test_every_kind_of_reply(spark):
    rows = [(f"r{k}", float(k)) for k in range(9)]
    log = {("r0", 1): "The number already exists", ("r0", 2): '{"Code":"already_exists"}', ("r1", 1): "requests_limit", ("r2", 1): "product_service down",
           ("r3", 1): MISMATCH, ("r4", 1): MISMATCH, ("r4", 2): MISMATCH, ("r5", 1): "invalid_total_payments", ("r6", 1): "no idea", ("r7", 1): None}
    got = check(spark, rows, [100], 10_000, [101, 105], log)
    assert got["r3"] == (106, 9.99, 2, "issued", "ok") and got["r4"][3:] == ("rejected", "total_mismatch")
    assert got["r0"][0] == 107  # refused with 102 and 108; the lowest number that a reject had given up by then is r4's
    assert got["r7"] == (None, 7.0, 0, "pending", "no_reply")


def test_rows_refused_beyond_the_limit(spark):
    rows = [(f"r{k}", 1.0) for k in range(6)]
    got = check(spark, rows, [95], 100, [], {("r0", 1): "already exists: number already exists", ("r1", 1): "error"})
    assert got["r5"][3:] == ("rejected", "limit_reached") and got["r0"][0] == 97


def test_rounds_end(spark):
    log = {("r0", a): "Rate limit" for a in range(1, 30)}
    assert check(spark, [("r0", 1.0), ("r1", 1.0)], [5], 100, [], log, rounds=4)["r0"] == (None, 1.0, 4, "rejected", "too_many_attempts")
    assert run(spark, [("r0", 1.0)], [], 100, [], {}) == {"r0": (None, 1.0, 0, "rejected", "register_empty")}
    assert run(spark, [], [5], 100, [], {}) == {}


@pytest.mark.parametrize("seed", [1, 2])
def test_random_replies(spark, seed):
    rng = random.Random(seed)
    rows = [(f"r{k:03d}", float(k)) for k in range(80)]
    kinds = ["ok", "number already exists", "requests_limit", MISMATCH, "error", "product_service"]
    log = {(k, a): rng.choice(kinds) for k, _ in rows for a in range(1, 5)}
    check(spark, rows, [50], 118, rng.sample(range(51, 118), 6), log, rounds=6)
