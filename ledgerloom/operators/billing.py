"""Bulk invoicing as a batch job.

pending movements -> client match (last row wins) -> new-customer payloads
-> note per account -> zero totals -> sequential numbers from the register
-> split -> invoice payloads; every row that stops on the way becomes one
reject (id, stage, reason).  Output tables are the hand-over to a sender.
``retry_rounds`` carries the sender's replies back: refused numbers, wrong
totals and outages are tried again, round by round.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.functions.numbers import (INVOICE_AMOUNT_COLUMNS, MONEY_SUM, cents_to_money,
                                          invoice_split_cents, safe_double)
from ledgerloom.functions.text import clean_code, clean_id, clean_phone, clean_text, utrim, zfill
from ledgerloom.operators.sequence import materialise, rank_ascending_range, ranked_within

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's for the same results.
# ---------------------------------------------------------------------------
INVOICE_NUMBER_LIMIT = 249_999
CUSTOMER_TYPE = "Customer"
PERSON_TYPE = "Person"
CUSTOMER_ID_TYPE = "13"
COUNTRY_CODE = "CO"
DEFAULT_ADDRESS = "No especificado"
ITEM_THIRD_PARTY = "GN1"
ITEM_COMMISSION = "SR02"
# Reply texts of the accounting provider and what they mean.
REPLY_TOTAL_MISMATCH = "invalid_total_payments"
REPLY_DUPLICATE = ["already_exists", "number already exists"]
REPLY_RATE_LIMIT = ["requests_limit", "Rate limit"]
REPLY_SERVICE_DOWN = ["product_service"]
REPLY_EXPECTED_TOTAL = r"calculated is\s*([0-9]+(?:\.[0-9]+)?)"
MAX_ATTEMPTS = 20
# ---------------------------------------------------------------------------

# An amount before rounding, and the size from which a number is no amount.
AMOUNT = "decimal(38,6)"
MAX_AMOUNT = 1e24


@dataclass(frozen=True)
class BillingConfig:
    """Provider ids and dates: configuration, never constants in code."""
    doc_id: int
    seller_id: int
    payment_id: int
    vat_tax_id: int | None
    third_party_id: str
    as_of: str                       # invoice date 'yyyy-MM-dd' (not now())
    number_limit: int = INVOICE_NUMBER_LIMIT
    allow_zero: bool = False


MOVEMENT_KEY = ["casillero", "source_file", "id_ingreso"]


def pending(movements: DataFrame) -> DataFrame:
    """Movements to invoice: a client id (cleaned, quirk Q22) and no invoice."""
    df = movements.withColumn("id_cliente", clean_id("id_cliente"))
    no_invoice = F.col("factura").isNull() | (utrim("factura") == "")
    return df.filter((F.col("id_cliente") != "") & no_invoice)


def preview(df: DataFrame, n: int = 50) -> DataFrame:
    """The first ``n`` rows of every account's listing (a feature of the screen, not a data cap).

    Each task keeps its own first ``n`` of an account before the shuffle
    (Spark's group limit below a rank filter), so an account's rows never
    meet; the global listing is not sorted.
    """
    w = Window.partitionBy("casillero").orderBy("source_file", "id_ingreso")
    return df.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n)


def client_index(clients: DataFrame, order_col: str = "ordinal") -> DataFrame:
    """One client per cleaned id; the last row (highest ``order_col``) wins.

    ``max_by`` aggregates map-side, so a duplicated id never gathers in one
    task.
    """
    c = clients.withColumn("_cid", clean_id("identificacion")).filter(F.col("_cid") != "")
    cols = [x for x in clients.columns if x != order_col]
    best = F.max_by(F.struct(*[F.col(x) for x in cols]), F.col(order_col))
    return c.groupBy("_cid").agg(best.alias("_c")).select(F.col("_cid").alias("client_id"), "_c.*")


def match_clients(pend: DataFrame, clients: DataFrame, keep=None) -> tuple[DataFrame, DataFrame]:
    """(matched rows with client columns prefixed 'cli_', rejects).

    One left join against the de-duplicated client index; matched rows and
    'client_not_found' rejects are two filters of it (``keep`` may
    materialise the joined frame so both read it once).
    """
    idx = client_index(clients)
    idx = idx.select("client_id", *[F.col(c).alias(f"cli_{c}") for c in idx.columns if c != "client_id"])
    j = pend.join(idx, pend["id_cliente"] == idx["client_id"], "left")
    if keep is not None:
        j = keep(j)
    matched = j.filter(F.col("client_id").isNotNull()).drop("client_id")
    rejects = j.filter(F.col("client_id").isNull()).select(*MOVEMENT_KEY, F.lit("match").alias("stage"),
                                                           F.lit("client_not_found").alias("reason"))
    return matched, rejects


def with_customer_fields(df: DataFrame, prefix: str = "") -> DataFrame:
    """Add cleaned customer fields (``f_*`` columns), surname rule applied.

    Built in steps on intermediate columns so no cleaned expression is
    nested twice (smaller plans, faster analysis and codegen).
    """
    def c(n):
        return F.col(f"{prefix}{n}")
    needed = ["identificacion", "nombres", "apellidos", "telefono", "correo", "codigo_departamento",
              "codigo_ciudad", "direccion", "nombre_completo"]
    missing = {f"{prefix}{n}": F.lit(None).cast("string") for n in needed if f"{prefix}{n}" not in df.columns}
    if missing:
        df = df.withColumns(missing)
    df = df.withColumns({
        "f_identification": clean_id(c("identificacion")),
        # a full name stands in where there are no first names
        "_n0": F.when(clean_text(c("nombres")) == "", clean_text(c("nombre_completo"))).otherwise(clean_text(c("nombres"))),
        "_a0": clean_text(c("apellidos")),
        "f_phone": clean_phone(c("telefono")),
        "f_email": clean_text(c("correo")),
        "f_state_code": zfill(clean_code(c("codigo_departamento")), 2),
        "f_city_code": zfill(clean_code(c("codigo_ciudad")), 5),
        "_dir": clean_text(c("direccion")),
    })
    df = df.withColumn("_tok", F.filter(F.split(utrim(F.col("_n0")), r"(?U)\s+"), lambda t: t != ""))
    n = F.size("_tok")
    need = F.col("_a0") == ""
    df = df.withColumns({
        "f_last_name": (F.when(need & (n >= 2), F.element_at("_tok", -1))
                        .when(need & (n == 1), F.element_at("_tok", 1)).otherwise(F.col("_a0"))),
        "f_first_name": (F.when(need & (n >= 2), F.array_join(F.slice("_tok", 1, n - 1), " "))
                         .when(need & (n == 1), F.element_at("_tok", 1)).otherwise(F.col("_n0"))),
        "f_address": F.when(F.col("_dir") == "", F.lit(DEFAULT_ADDRESS)).otherwise(F.col("_dir")),
    })
    return df.drop("_n0", "_a0", "_tok", "_dir")


def customer_fields() -> dict:
    """Column expressions of the customer fields (for one-off selects)."""
    names = ["identification", "first_name", "last_name", "phone", "email", "state_code", "city_code",
             "address"]
    return {k: F.col(f"f_{k}") for k in names}


def customer_reason(f: dict):
    """First failing completeness check (null = complete), reference order."""
    return (F.when(f["identification"] == "", F.lit("empty_id"))
            .when(f["first_name"] == "", F.lit("empty_names"))
            .when(f["last_name"] == "", F.lit("empty_surnames"))
            .when(f["phone"] == "", F.lit("empty_phone"))
            .when(f["email"] == "", F.lit("empty_email"))
            .when(f["state_code"].isin("00", "0") | f["city_code"].isin("00000", "0"), F.lit("invalid_code")))


#: The reasons by number, so that the client index aggregates numbers only (0: complete).
CUSTOMER_REASONS = ["empty_id", "empty_names", "empty_surnames", "empty_phone", "empty_email", "invalid_code"]


def customer_states(clients: DataFrame, known_customers: DataFrame, order_col: str = "ordinal") -> DataFrame:
    """(client_id, creason): one row per cleaned client id, the last row's; why its customer cannot be created, null if
    it can or the provider knows it.

    Only two numbers a client are aggregated, whatever the width of the table.
    """
    c = clients.withColumn("_cid", clean_id("identificacion")).filter(F.col("_cid") != "")
    reason = customer_reason(customer_fields())
    code = F.coalesce(F.array_position(F.array(*[F.lit(r) for r in CUSTOMER_REASONS]), reason), F.lit(0)).cast("int")
    c = with_customer_fields(c).select("_cid", F.col(order_col).alias("_o"), code.alias("_code"))
    last = c.groupBy("_cid").agg(F.max_by("_code", "_o").alias("_code"))
    known = known_customers.select(clean_id("identificacion").alias("_cid")).distinct().withColumn("_known", F.lit(True))
    text = F.element_at(F.array(*[F.lit(r) for r in CUSTOMER_REASONS]), F.col("_code"))
    return last.join(known, "_cid", "left").select(
        F.col("_cid").alias("client_id"), F.when(F.col("_known").isNull() & (F.col("_code") > 0), text).alias("creason"))


def customer_payload_json(f: dict):
    payload = F.struct(
        F.lit(CUSTOMER_TYPE).alias("type"), F.lit(PERSON_TYPE).alias("person_type"),
        F.lit(CUSTOMER_ID_TYPE).alias("id_type"), f["identification"].alias("identification"),
        F.array(f["first_name"], f["last_name"]).alias("name"),
        F.struct(f["address"].alias("address"),
                 F.struct(F.lit(COUNTRY_CODE).alias("country_code"), f["state_code"].alias("state_code"),
                          f["city_code"].alias("city_code")).alias("city")).alias("address"),
        F.array(F.struct(f["phone"].alias("number"))).alias("phones"),
        F.array(F.struct(f["first_name"].alias("first_name"), f["last_name"].alias("last_name"),
                         f["email"].alias("email"))).alias("contacts"))
    return F.to_json(payload)


def new_customers(matched: DataFrame, known_customers: DataFrame) -> DataFrame:
    """Distinct clients of the matched rows that the provider does not know,
    with payload or the reason it cannot be built."""
    cli_cols = [c for c in matched.columns if c.startswith("cli_")]
    cl = matched.select(F.col("id_cliente"), *cli_cols).dropDuplicates(["id_cliente"])
    known = known_customers.select(clean_id("identificacion").alias("id_cliente")).distinct()
    cl = with_customer_fields(cl.join(known, "id_cliente", "left_anti"), "cli_")
    f = customer_fields()
    reason = customer_reason(f)
    return cl.select("id_cliente", reason.alias("reason"),
                     F.when(reason.isNull(), customer_payload_json(f)).alias("payload"))


def invoice_total(df: DataFrame):
    """First usable amount among the present amount columns, unrounded (six
    decimals).  A number that is not finite, or too large to be an amount,
    gives 0: it is 'usable' but not chargeable, as in the reference."""
    present = [c for c in INVOICE_AMOUNT_COLUMNS if c in df.columns]
    zero = F.lit(0).cast(AMOUNT)

    def amount(c):
        d = safe_double(c)
        exact = F.coalesce(F.col(c).try_cast(AMOUNT), d.try_cast(AMOUNT))
        return F.when(d.isNotNull(), F.when(F.abs(d) < MAX_AMOUNT, exact).otherwise(zero))

    return F.coalesce(*[amount(c) for c in present], zero)


def with_split(df: DataFrame, vat: bool = True) -> DataFrame:
    """Add T and its split (exact; from the unrounded T)."""
    return split_total(df.withColumn("_t", invoice_total(df)), vat)


def split_total(df: DataFrame, vat: bool = True) -> DataFrame:
    """``with_split`` of the total that ``_t`` holds."""
    gn1, sr02, iva = invoice_split_cents(F.col("_t") * 100, with_vat=vat)
    df = df.withColumns({"_g": gn1, "_s": sr02, "_v": iva})
    return df.withColumns({
        "total_charged": F.col("_t").cast(MONEY_SUM),
        "gn1": cents_to_money(F.col("_g")),
        "sr02": cents_to_money(F.col("_s")),
        "iva": cents_to_money(F.col("_v")),
        "invoice_total": cents_to_money(F.col("_g") + F.col("_s") + F.col("_v")),
        "zero_total": F.round(F.col("_t"), 2) <= 0,
    }).drop("_t", "_g", "_s", "_v")


def register_max(register: DataFrame) -> DataFrame:
    """Highest invoice number in the register (consecutive, else number);
    values that are not integers are skipped.  One row."""
    return typed_register(register).agg(F.max("last_number").alias("last_number"))


def typed_register(register: DataFrame) -> DataFrame:
    """The register with its numbers as numbers (``last_number``), as it is best stored; unreadable ones are null."""
    c = F.col("consecutive")
    v = F.when(c.isNull() | (utrim(c) == ""), F.col("number")).otherwise(c)
    return register.withColumn("last_number", utrim(v).try_cast("bigint"))


def register_numbers(register: DataFrame) -> DataFrame:
    """The readable numbers alone, the form in which the register's maximum is kept: every file then has statistics."""
    return typed_register(register).filter(F.col("last_number").isNotNull()).select("last_number")


def stored_register_max(spark: SparkSession, path: str) -> DataFrame:
    """Highest of the ``register_numbers`` stored as Parquet, from the files' statistics; one row, as ``register_max``.

    Spark's second Parquet reader answers the maximum from the footers; no
    row is read. The settings are the session's again when this returns.
    """
    wanted = {"spark.sql.sources.useV1SourceList": "", "spark.sql.parquet.aggregatePushdown": "true"}
    before = {k: spark.conf.get(k) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        best = spark.read.parquet(path).agg(F.max("last_number").alias("last_number"))
        row = best.first()
        plan = best._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    if "PushedAggregation: [MAX(last_number)]" not in plan:
        raise RuntimeError("the maximum was not answered from statistics")
    return spark.createDataFrame([(row["last_number"],)], "last_number bigint")


def assign_numbers(valid: DataFrame, register: DataFrame, reserved: DataFrame | None,
                   limit: int, order_cols=MOVEMENT_KEY) -> tuple[DataFrame, DataFrame]:
    """Sequential numbers from register max + 1 over ``valid`` rows in order,
    skipping reserved numbers, never above ``limit``.

    Returns (numbered rows, rejects 'limit_reached').  The candidate list is
    [start, limit] minus reserved, bounded by the legal limit and ranked in
    place; the rows are ranked with the skew-safe sequence operator; the two
    are joined on the rank.
    """
    spark = valid.sparkSession
    # register max as a scalar subquery: evaluated once, no join
    # an empty or unreadable register gives no start: every row is rejected, nothing is numbered from 1
    start = register_max(register).select((F.coalesce("last_number", F.lit(limit)) + 1).alias("s")).scalar()
    known = register_max(register).select(F.col("last_number").isNotNull().alias("k")).scalar()
    # at most ``limit`` rows, made once for the numbered rows and the rest
    free = materialise(rank_ascending_range(spark, start, limit, reserved))
    ranked = ranked_within(valid, [], list(order_cols), rank_col="k")
    out = ranked.join(free, "k", "left")
    numbered = out.filter(F.col("number").isNotNull()).drop("k")
    over = out.filter(F.col("number").isNull()).select(*MOVEMENT_KEY, F.lit("number").alias("stage"),
                                                         F.when(known, "limit_reached").otherwise("register_empty").alias("reason"))
    return numbered, over


def invoice_payload_json(cfg: BillingConfig):
    price1 = F.col("gn1").cast("double")
    price2 = F.col("sr02").cast("double")
    taxes = (F.array(F.struct(F.lit(cfg.vat_tax_id).alias("id"))) if cfg.vat_tax_id is not None
             else F.array().cast("array<struct<id:int>>"))
    item1 = F.struct(F.lit(ITEM_THIRD_PARTY).alias("code"), F.lit(1).alias("quantity"), price1.alias("price"),
                     F.array().cast("array<struct<id:int>>").alias("taxes"),
                     F.struct(F.lit(cfg.third_party_id).alias("identification")).alias("customer"))
    item2 = F.struct(F.lit(ITEM_COMMISSION).alias("code"), F.lit(1).alias("quantity"), price2.alias("price"),
                     taxes.alias("taxes"),
                     F.lit(None).cast("struct<identification:string>").alias("customer"))
    payload = F.struct(
        F.struct(F.lit(cfg.doc_id).alias("id")).alias("document"),
        F.lit(cfg.as_of).alias("date"),
        F.col("number").alias("number"),
        F.struct(F.col("id_cliente").alias("identification")).alias("customer"),
        F.struct(F.lit(False).alias("send")).alias("stamp"),
        F.struct(F.lit(False).alias("send")).alias("mail"),
        F.lit(cfg.seller_id).alias("seller"),
        F.array(item1, item2).alias("items"),
        F.array(F.struct(F.lit(cfg.payment_id).alias("id"), F.col("invoice_total").cast("double").alias("value"),
                         F.lit(cfg.as_of).alias("due_date"))).alias("payments"),
        F.col("note").alias("observations"),
        F.create_map().cast("map<string,string>").alias("additional_fields"))
    # nulls are left out of the text (the commission item has no customer)
    return F.to_json(payload, {"ignoreNullFields": "true"})


class BillingRun:
    """One billing batch.  The four outputs (``invoices``, ``new_customers``,
    ``rejects``, ``summary``) are built on first use, so a caller that needs
    one table does not plan the others; shared stages (matched rows, valid
    rows) are computed once for all of them."""

    def __init__(self, movements: DataFrame, clients: DataFrame, known_customers: DataFrame, notes: DataFrame,
                 register: DataFrame, cfg: BillingConfig, reserved: DataFrame | None = None,
                 materialize: str = "persist"):
        self.movements, self.clients, self.known, self.notes = movements, clients, known_customers, notes
        self.register, self.cfg, self.reserved, self.how = register, cfg, reserved, materialize
        self._cached: list[DataFrame] = []

    def _keep(self, df: DataFrame) -> DataFrame:
        out = materialise(df, self.how)
        if self.how == "persist":
            self._cached.append(out)
        return out

    @cached_property
    def pending(self) -> DataFrame:
        return pending(self.movements)

    @cached_property
    def new_customers(self) -> DataFrame:
        return new_customers(match_clients(self.pending, self.clients)[0], self.known)

    @cached_property
    def _judged(self) -> DataFrame:
        """Pending rows with the stage and reason at which they stop (null: valid) and their amount: one pass, kept."""
        states = customer_states(self.clients, self.known)
        m = self.pending.join(states, F.col("id_cliente") == F.col("client_id"), "left")
        nt = self.notes.select(F.col("code").alias("casillero"), F.col("text").alias("note"))
        m = m.join(nt, "casillero", "left").withColumn("_t", invoice_total(m))
        zero = F.lit(False) if self.cfg.allow_zero else F.round("_t", 2) <= 0
        stage = (F.when(F.col("client_id").isNull(), F.struct(F.lit("match").alias("stage"), F.lit("client_not_found").alias("reason")))
                 .when(F.col("creason").isNotNull(), F.struct(F.lit("customer").alias("stage"), F.col("creason").alias("reason")))
                 .when(F.col("note").isNull(), F.struct(F.lit("invoice").alias("stage"), F.lit("no_note").alias("reason")))
                 .when(zero, F.struct(F.lit("invoice").alias("stage"), F.lit("zero_total").alias("reason"))))
        return self._keep(m.withColumn("_stop", stage).select(
            *MOVEMENT_KEY, "id_cliente", "note", "_t",
            F.col("_stop.stage").alias("stage"), F.col("_stop.reason").alias("reason")))

    def _split(self, df: DataFrame) -> DataFrame:
        return split_total(df, vat=self.cfg.vat_tax_id is not None).drop("zero_total")

    @cached_property
    def _unsplit(self) -> DataFrame:
        return self._judged.filter(F.col("stage").isNull()).drop("stage", "reason")

    @cached_property
    def valid(self) -> DataFrame:
        """Rows that may be invoiced, not numbered yet."""
        return self._split(self._unsplit)

    @cached_property
    def _numbered(self) -> tuple[DataFrame, DataFrame]:
        # rows are sorted with their amount only; those that get a number are split
        return assign_numbers(self._unsplit, self.register, self.reserved, self.cfg.number_limit)

    @cached_property
    def invoices(self) -> DataFrame:
        return self._split(self._numbered[0]).select(
            *MOVEMENT_KEY, "id_cliente", "number", "total_charged", "gn1", "sr02", "iva", "invoice_total", "note",
            invoice_payload_json(self.cfg).alias("payload"))

    @cached_property
    def rejects(self) -> DataFrame:
        stopped = self._judged.filter(F.col("stage").isNotNull()).select(*MOVEMENT_KEY, "stage", "reason")
        return stopped.unionByName(self._numbered[1])

    def settle(self, ask, rounds: int = MAX_ATTEMPTS) -> DataFrame:
        """The valid rows after up to ``rounds`` of asking the provider (see ``retry_rounds``)."""
        rows = self.valid.select(*MOVEMENT_KEY, F.col("invoice_total").alias("value"))
        return retry_rounds(rows, self.register, self.reserved, self.cfg.number_limit, ask, rounds)

    @cached_property
    def summary(self) -> DataFrame:
        return billing_summary(self.movements, self.pending, self.invoices, self.rejects)

    def release(self) -> None:
        """Drop the cached shared stages once the outputs are written."""
        for f in self._cached:
            f.unpersist()
        self._cached.clear()


def billing_run(movements: DataFrame, clients: DataFrame, known_customers: DataFrame, notes: DataFrame,
                register: DataFrame, cfg: BillingConfig, reserved: DataFrame | None = None,
                materialize: str = "persist") -> BillingRun:
    """pending -> match -> customers -> note -> zero -> numbers -> payloads."""
    return BillingRun(movements, clients, known_customers, notes, register, cfg, reserved, materialize)


def billing_summary(movements: DataFrame, pend: DataFrame, invoices: DataFrame, rejects: DataFrame) -> DataFrame:
    """Counts per account: read, pending, issued, failed (one aggregate)."""
    tagged = (movements.select("casillero", F.lit("read").alias("k"))
              .unionByName(pend.select("casillero", F.lit("pending").alias("k")))
              .unionByName(invoices.select("casillero", F.lit("issued").alias("k")))
              .unionByName(rejects.select("casillero", F.lit("failed").alias("k"))))
    return (tagged.groupBy("casillero")
            .agg(*[F.count_if(F.col("k") == k).alias(f"n_{k}") for k in ("read", "pending", "issued", "failed")]))


def writeback(movements: DataFrame, invoices: DataFrame) -> DataFrame:
    """Invoice numbers written to every movement row of the account with that
    id (all source files, quirk Q13), the highest one; other rows keep their value."""
    nums = (invoices.select(F.col("casillero").alias("_a"), utrim("id_ingreso").alias("_k"), F.col("number").cast("bigint").alias("_num"))
            .groupBy("_a", "_k").agg(F.max("_num").alias("_num")))
    j = movements.join(nums, (movements["casillero"] == nums["_a"]) & (utrim(movements["id_ingreso"]) == nums["_k"]), "left")
    return j.withColumn("factura", F.coalesce(F.col("_num").cast("string"), F.col("factura"))).drop("_a", "_k", "_num")


def reply_triage(replies: DataFrame) -> DataFrame:
    """Classify provider replies; pull the provider's expected total."""
    r = F.coalesce(F.col("reply"), F.lit(""))

    def any_of(words):
        cond = F.lit(False)
        for w in words:
            cond = cond | r.contains(w)
        return cond
    cat = (F.when(F.lower(utrim(r)) == "ok", F.lit("ok"))
           .when(r.contains(REPLY_TOTAL_MISMATCH), F.lit("total_mismatch"))
           .when(any_of(REPLY_DUPLICATE), F.lit("duplicate_number"))
           .when(any_of(REPLY_RATE_LIMIT), F.lit("rate_limit"))
           .when(any_of(REPLY_SERVICE_DOWN), F.lit("service_down"))
           .otherwise(F.lit("error")))
    expected = F.regexp_extract(r, REPLY_EXPECTED_TOTAL, 1)
    expected = F.when(cat == "total_mismatch", F.when(expected != "", expected.try_cast("decimal(38,2)")))
    return replies.withColumn("category", cat).withColumn("expected_total", expected)


def _next_step():
    """What a reply does to its row: issued, renumber, again, no_reply or error; the mismatch of a corrected payment is an error."""
    c = F.col("category")
    return (F.when(F.col("reply").isNull(), F.lit("no_reply"))
            .when(c == "ok", F.lit("issued"))
            .when(c == "duplicate_number", F.lit("renumber"))
            .when(c.isin("rate_limit", "service_down"), F.lit("again"))
            .when((c == "total_mismatch") & ~F.col("corrected") & F.col("expected_total").isNotNull(), F.lit("correct"))
            .otherwise(F.lit("error")))


def _without_number(rows: DataFrame, key: list[str], reason: str) -> DataFrame:
    return rows.select(*key, F.lit(None).cast("bigint").alias("number"), "value", "attempts", F.lit("rejected").alias("outcome"),
                       F.lit(reason).alias("reason"))


def retry_rounds(valid: DataFrame, register: DataFrame, reserved: DataFrame | None, limit: int, ask,
                 rounds: int = MAX_ATTEMPTS, order_cols=MOVEMENT_KEY) -> DataFrame:
    """Number ``valid`` (key columns and ``value``, the payment) and ask the provider until nothing is left to do.

    ``ask`` takes the proposals of a round (key columns, ``number``,
    ``value``, ``attempt`` from 1) and returns them with ``reply`` (null: none
    yet). By its reply a row is issued; gives its number up and takes the next
    free one; pays the provider's total next time; is asked again as it is; or
    is rejected, and its number goes to a row that needs one (the lowest
    first), so rejects leave no gap. Numbers are never handed out twice and
    never pass ``limit``. The rounds end when no row is left, when a round
    brings no reply at all, or after ``rounds``.

    Returns the key columns, ``number`` (issued rows), ``value`` (as last
    asked), ``attempts``, ``outcome`` (issued, rejected, pending) and
    ``reason`` (the reply's category, limit_reached, register_empty,
    too_many_attempts, no_reply).

    State between rounds is a table of the shared folder: each round reads
    only the rows still open, and what an earlier one settled is not computed
    again. The driver holds counts. Ranks come from the skew-safe sequence
    operator; free numbers are at most ``limit``.
    """
    spark = valid.sparkSession
    key = list(order_cols)

    def keep(df):
        return materialise(df, "checkpoint")

    def ranked(df, order, name):
        return ranked_within(df, [], order, rank_col=name, materialize="checkpoint")

    last = register_max(register).first()["last_number"]
    start = limit + 1 if last is None else last + 1
    free = keep(rank_ascending_range(spark, F.lit(start), limit, reserved))
    n_free = free.count()
    columns = [*key, "k", "number", "value", "attempts", "corrected"]
    # rows take their number with them; only those that get another one meet the list of numbers again
    listed = ranked(valid.select(*key, "value"), order_cols, "k").withColumns({"attempts": F.lit(0), "corrected": F.lit(False)})
    top = listed.count()
    settled, spare, left = [], None, top
    n_spare = 0
    none = "register_empty" if last is None else "limit_reached"
    if top > n_free:
        # the rows beyond the last number wait in the ranked table only; no round reads them
        settled.append(_without_number(listed.filter(F.col("k") > n_free), key, none))
        left = n_free
    open_rows = keep(listed.join(free, "k").select(*columns))
    for _ in range(rounds):
        if not left:
            break
        if top > n_free:
            settled.append(_without_number(open_rows.filter(F.col("number").isNull()), key, none))
        asked = ask(open_rows.filter(F.col("number").isNotNull()).select(
            *key, "number", "value", (F.col("attempts") + 1).alias("attempt"), "k", "corrected"))
        state = keep(reply_triage(asked).withColumn("step", _next_step()).select(
            *key, "k", "number", F.when(F.col("step") == "correct", F.col("expected_total").cast(MONEY_SUM))
            .otherwise(F.col("value")).alias("value"),
            F.when(F.col("step") == "no_reply", F.col("attempt") - 1).otherwise(F.col("attempt")).alias("attempts"),
            (F.col("step") == "correct").alias("corrected"), "step", "category"))
        n = {r["step"]: r["count"] for r in state.groupBy("step").count().collect()}
        if n.get("issued") or n.get("error"):
            settled.append(state.filter(F.col("step").isin("issued", "error")).select(
                *key, F.when(F.col("step") == "issued", F.col("number")).alias("number"), "value", "attempts",
                F.when(F.col("step") == "issued", "issued").otherwise("rejected").alias("outcome"), F.col("category").alias("reason")))
        if n.get("error"):
            given_up = state.filter(F.col("step") == "error").select("k")
            spare = given_up if spare is None else spare.select("k").unionByName(given_up)
            n_spare += n["error"]
        open_rows = state.filter(F.col("step").isin("again", "correct", "no_reply")).select(*columns)
        if n.get("renumber"):
            m = n["renumber"]
            refused = ranked(state.filter(F.col("step") == "renumber").select(*key, "k", "value", "attempts", "corrected"), ["k"], "j").drop("k")
            if n_spare:
                in_order = ranked(spare.select("k"), ["k"], "j")
                refused = refused.join(in_order, "j", "left")
                spare = in_order.filter(F.col("j") > m).select("k")
            else:
                refused = refused.withColumn("k", F.lit(None).cast("bigint"))
            refused = refused.withColumn("k", F.coalesce("k", F.col("j") - n_spare + top)).join(free, "k", "left").select(*columns)
            top += max(0, m - n_spare)
            n_spare = max(0, n_spare - m)
            open_rows = open_rows.unionByName(refused)
        left = sum(n.get(s, 0) for s in ("again", "correct", "no_reply", "renumber"))
        if set(n) <= {"no_reply"}:
            break
        if left:
            open_rows = keep(open_rows)
    if left:
        waiting = F.col("attempts") < rounds
        settled.append(open_rows.select(
            *key, F.lit(None).cast("bigint").alias("number"), "value", "attempts",
            F.when(waiting, "pending").otherwise("rejected").alias("outcome"),
            F.when(waiting, "no_reply").otherwise("too_many_attempts").alias("reason")))
    out = settled[0] if settled else open_rows.select(
        *key, F.lit(None).cast("bigint").alias("number"), "value", "attempts", F.lit("").alias("outcome"), F.lit("").alias("reason"))
    for s in settled[1:]:
        out = out.unionByName(s)
    return out
