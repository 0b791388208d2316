"""Table upkeep: registration, batch changes, cascading deletes, counters, validation."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lendlake.functions.bands import score_bands
from lendlake.functions.columns import blank_to_null
from lendlake.functions.keys import first_free, numbered
from lendlake.functions.sequences import look_back
from lendlake.functions.workspace import checkpointed
from lendlake.operators.lifecycle import day
from lendlake.schema import (
    CHECKS,
    DOMAINS,
    KEY,
    MAX_LENGTH,
    REFERENCES,
    REQUIRED,
    TABLES,
    UNIQUE,
)
from lendlake.sources.tables import Tables

# The choices and limits of the entry forms.
TENURES = (12, 18, 24, 36, 48, 60, 84, 120, 180, 240, 300, 360)
LOAN_AMOUNT_MIN = 10_000
RATE_RANGE = (5, 25)
PAYMENT_MIN, PAYMENT_MAX_FACTOR = "0.01", "1.5"
TYPE_RATE_RANGE = (1, 30)
TYPE_AMOUNT_RANGE = (10_000, 50_000_000)
BAND_MIN_RANGE = (300, 899)
BAND_MAX_RANGE = (301, 900)
INCOME_RANGE = (1_000, 10_000_000)
BIRTH_RANGE = ("1940-01-01", "2005-12-31")


# --- registration ----------------------------------------------------------------------------

CONTACTS = ("phone", "email")


# Open requests that one task reads in order: about 200 MB of contacts.
IN_ORDER = 1_000_000


def _first_in_line(requests: DataFrame) -> DataFrame:
    """Requests no earlier request shares a phone or an email with.

    The winners of a contact are found by a minimum (combined before the shuffle), then matched
    on the unique request id: one phone on a third of all requests is no hot join key.
    """
    first = requests
    for contact in CONTACTS:
        winners = requests.groupBy(contact).agg(F.min("request_id").alias("request_id"))
        first = first.join(winners.select("request_id"), "request_id", "left_semi")
    return first


def _without_contacts_of(requests: DataFrame, taken: DataFrame) -> DataFrame:
    for contact in CONTACTS:
        requests = requests.join(taken.select(contact).distinct(), contact, "left_anti")
    return requests


def _resolved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Accepted request ids of rows (request_id, contacts) in order: a request is accepted if
    nobody accepted before it has one of its contacts."""
    taken = [set() for _ in CONTACTS]
    for batch in batches:
        won = []
        for request, *contacts in zip(*(x.to_pylist() for x in batch.columns)):
            if not any(value in seen for value, seen in zip(contacts, taken)):
                won.append(request)
                for value, seen in zip(contacts, taken):
                    seen.add(value)
        yield pa.RecordBatch.from_arrays([pa.array(won, type=pa.int64())], ["request_id"])


def accepted_requests(customers: DataFrame, batch: DataFrame, in_order: int = IN_ORDER) -> DataFrame:
    """The requests that would succeed if the batch were entered one by one by request_id.

    A request fails when an existing customer or an earlier *successful* request has its phone
    or email. Requests whose contacts nobody else gives succeed at once. Of the others all first in
    line succeed together, those they block leave, and the rest moves up: the first round settles
    contacts that very many give. Once at most ``in_order`` requests are left, as many as one task
    can hold, they are read in order in one pass, so a long chain of requests that share contacts in
    turn (r1 and r2 a phone, r2 and r3 an email, ...) costs no round a link.
    """
    complete = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in ("name", *CONTACTS)])
    waiting = checkpointed(_without_contacts_of(batch.where(complete), customers)
                           .select("request_id", *CONTACTS))
    shared = waiting.select("request_id").limit(0)
    for contact in CONTACTS:
        several = waiting.groupBy(contact).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
        shared = shared.unionByName(waiting.join(several, contact, "left_semi").select("request_id"))
    shared = checkpointed(shared.distinct())
    accepted = waiting.join(shared, "request_id", "left_anti").select("request_id")
    waiting = checkpointed(waiting.join(shared, "request_id", "left_semi"))
    while waiting.count() > in_order:
        won = checkpointed(_first_in_line(waiting))
        accepted = accepted.unionByName(won.select("request_id"))
        waiting = checkpointed(_without_contacts_of(waiting, won))
    return accepted.unionByName(
        waiting.select("request_id", *CONTACTS).coalesce(1).sortWithinPartitions("request_id")
        .mapInArrow(_resolved, "request_id bigint"))


def register_customers(t: Tables, batch: DataFrame,
                       as_of: str) -> tuple[dict[str, DataFrame], DataFrame, DataFrame]:
    """New rows for customer, income, address and counters, the rejected requests with reasons,
    and request_id with customer_id of the accepted ones. New keys are dense, in request order.

    ``batch``: request_id (unique), name, dob, phone, email, monthly_income,
    employment_type, company_name, street, city, zip_code.
    """
    texts = ("name", "phone", "email", "company_name", "street", "city", "zip_code")
    required = ("name", *CONTACTS)
    clean = batch.select(*[
        (blank_to_null(F.col(c)) if c in required else F.trim(c)).alias(c)
        if c in texts else F.col(c) for c in batch.columns])
    accepted = accepted_requests(t.customer, clean)
    good = numbered(clean.join(accepted, "request_id", "left_semi"), ["request_id"], "_n").withColumn(
        "customer_id", first_free(t.customer, "customer_id") + F.col("_n"))

    def key(table: str) -> Column:
        return (first_free(t[table], KEY[table]) + F.col("_n")).alias(KEY[table])

    new = {
        "customer": good.select("customer_id", "name", "dob", "phone", "email",
                                day(as_of).cast("timestamp_ntz").alias("created_at")),
        "income_details": good.select(
            key("income_details"), "customer_id",
            F.col("monthly_income").cast("decimal(12,2)").alias("monthly_income"),
            "employment_type", "company_name"),
        "address_details": good.select(key("address_details"), "customer_id", "street", "city",
                                       "zip_code"),
        "credit_history": good.select(
            key("credit_history"), "customer_id", F.lit(0).alias("total_loans"),
            F.lit(0).alias("total_defaults"), day(as_of).alias("last_updated")),
    }
    missing = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in required])
    rejected = clean.join(accepted, "request_id", "left_anti").select(
        "request_id", F.when(missing, "missing field").otherwise("duplicate contact")
        .alias("reason"))
    return new, rejected, good.select("request_id", "customer_id")


# --- batch changes and deletes ---------------------------------------------------------------

def apply_changes(base: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Upsert and delete by key.

    ``changes``: the columns of ``base`` plus ``op`` ('upsert' or 'delete') and ``seq``; of
    several changes to one key the highest seq counts. The top-1 per key is cut down inside each
    map task first (window group limit), so a key with very many changes stays cheap.
    """
    newest = Window.partitionBy(key).orderBy(F.desc("seq"))
    final = (changes.withColumn("_rn", F.row_number().over(newest)).where(F.col("_rn") == 1))
    kept = base.join(final.select(key), key, "left_anti")
    upserts = final.where(F.col("op") == "upsert").select(*base.columns)
    return kept.select(*base.columns).unionByName(upserts)


def _rule_reasons(t: Tables, table: str, changes: DataFrame) -> DataFrame:
    """``changes`` with ``reason``: the first rule of rows, references or uses that a change breaks.

    These rules look at other tables or at the change alone, so the order of the batch is of no
    matter. Every join has a shuffle straight below both sides: a parent that a third of the changes
    name is split by adaptive execution.
    """
    key, upsert = KEY[table], F.col("op") == "upsert"
    reasons = [F.when(~F.col("op").isin("upsert", "delete") | F.col("op").isNull(), "unknown op"),
               F.when(F.col(key).isNull(), f"{key} not null")]
    reasons += [F.when(upsert & F.expr(bad), rule) for rule, bad in _row_rules(table).items()]
    found = changes
    for i, ref in enumerate(r for r in REFERENCES if r.child == table):
        parents = t[ref.parent].select(F.col(KEY[ref.parent]).alias(f"_parent{i}"))
        found = found.join(parents, F.col(ref.column) == F.col(f"_parent{i}"), "left")
        reasons.append(F.when(upsert & F.col(ref.column).isNotNull()
                              & F.col(f"_parent{i}").isNull(), f"no {ref.parent}"))
    deleted = changes.where("op = 'delete'").select(key).distinct()
    for i, ref in enumerate(r for r in REFERENCES if r.parent == table and not r.cascades):
        used = checkpointed(deleted.join(
            t[ref.child].select(F.col(ref.column).alias(key)), key, "left_semi").select(
            F.col(key).alias(f"_used{i}")))
        found = found.join(used, F.col(key) == F.col(f"_used{i}"), "left")
        reasons.append(F.when((F.col("op") == "delete") & F.col(f"_used{i}").isNotNull(),
                              f"used by {ref.child}"))
    return found.select(*changes.columns, F.coalesce(*reasons).alias("reason"))


def _line_of(waiting: DataFrame, held: DataFrame, key: str, unique: tuple[str, ...]) -> DataFrame:
    """seq and all that a change may take or set free: its key, the values it asks for, and the
    values its key holds."""
    own = held.select(F.col(key).alias("_own"), *[F.col(u).alias(f"_old_{u}") for u in unique])
    marked = [F.concat(F.lit("key:"), F.col(key).cast("string"))]
    for u in unique:
        marked += [F.when(F.col("op") == "upsert", F.concat(F.lit(f"{u}:"), u)),
                   F.concat(F.lit(f"{u}:"), f"_old_{u}")]
    return waiting.join(own, F.col(key) == F.col("_own"), "left").select(
        "seq", F.array_compact(F.array_distinct(F.array(*marked))).alias("_what"))


def _holders(changes: DataFrame, held: DataFrame, key: str, unique: tuple[str, ...]) -> DataFrame:
    """``changes`` with ``_by_<u>``: the other key that holds the asked value now, if any."""
    for u in unique:
        by = held.select(F.col(u).alias("_value"), F.col(key).alias(f"_by_{u}"))
        changes = changes.join(
            by, (F.col("op") == "upsert") & (F.col(u) == F.col("_value"))
            & (F.col(key) != F.col(f"_by_{u}")), "left").drop("_value")
    return changes


def _one_round(waiting: DataFrame, held: DataFrame, key: str,
               unique: tuple[str, ...]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Changes still waiting, values held and changes refused after one round.

    A change that is first in line for its key and all its values cannot be touched by an earlier
    one, so all such changes are decided at once. Then those are refused that ask for a value whose
    holder has no earlier change waiting: a value that very many ask for takes a round for each
    change of its holder, not for each who asks.
    """
    line = _line_of(waiting, held, key, unique)
    won = (line.select("seq", F.explode("_what").alias("_one")).groupBy("_one")
           .agg(F.min("seq").alias("seq")).groupBy("seq").agg(F.count(F.lit(1)).alias("_won")))
    ready = checkpointed(line.join(won, "seq").where(F.size("_what") == F.col("_won")).select("seq"))
    taken = reduce(lambda a, b: a | b, [F.col(f"_by_{u}").isNotNull() for u in unique])
    judged = checkpointed(_holders(waiting.join(ready, "seq", "left_semi"), held, key, unique)
                          .withColumn("_refused", taken))
    accepted = judged.where(~F.col("_refused"))
    held = checkpointed(held.join(accepted.select(key), key, "left_anti").unionByName(
        accepted.where("op = 'upsert'").select(*held.columns)))
    waiting = checkpointed(waiting.join(ready, "seq", "left_anti"))

    first = checkpointed(waiting.groupBy(F.col(key).alias("_key")).agg(F.min("seq").alias("_first")))
    asked = _holders(waiting, held, key, unique)
    for u in unique:
        asked = asked.join(first.select(F.col("_key").alias(f"_by_{u}"),
                                        F.col("_first").alias(f"_next_{u}")), f"_by_{u}", "left")
    stuck = reduce(lambda a, b: a | b, [
        F.col(f"_by_{u}").isNotNull() & (F.coalesce(f"_next_{u}", F.col("seq")) >= F.col("seq"))
        for u in unique])
    hopeless = checkpointed(asked.where(stuck).select("seq"))
    return (checkpointed(waiting.join(hopeless, "seq", "left_anti")), held,
            judged.where("_refused").select("seq").unionByName(hopeless))


def _refused_in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """seq of the changes refused among rows (seq, op, key, values) in order, after the rows held."""
    holder: list[dict] = []
    values: dict[object, tuple] = {}
    for batch in batches:
        refused = []
        for seq, op, key, *asked in zip(*(x.to_pylist() for x in batch.columns)):
            holder = holder or [{} for _ in asked]
            if op == "upsert" and any(h.get(v, key) != key for h, v in zip(holder, asked)):
                refused.append(seq)
                continue
            for h, v in zip(holder, values.pop(key, ())):
                del h[v]
            if op != "delete":
                values[key] = tuple(asked)
                for h, v in zip(holder, asked):
                    h[v] = key
        yield pa.RecordBatch.from_arrays([pa.array(refused, type=pa.int64())], ["seq"])


def _doubles(base: DataFrame, changes: DataFrame, key: str, unique: tuple[str, ...],
             in_order: int) -> DataFrame:
    """seq of the changes that ask for a value another row holds when it is their turn."""
    waiting = checkpointed(changes.select("seq", "op", key, *unique))
    columns = [key, *unique]
    held = base.select(*columns)
    touched = [held.join(waiting.select(c).distinct(), c, "left_semi").select(*columns)
               for c in columns]
    held = checkpointed(reduce(DataFrame.unionByName, touched).distinct())
    refused = waiting.select("seq").limit(0)
    while True:
        waiting, held, lost = _one_round(waiting, held, key, unique)
        refused = refused.unionByName(lost)
        if waiting.count() <= in_order:
            break
    wanted = [held.join(waiting.select(c).distinct(), c, "left_semi").select(*columns)
              for c in columns]
    rows = reduce(DataFrame.unionByName, wanted).distinct().select(
        F.lit(None).cast("bigint").alias("seq"), F.lit("held").alias("op"), *columns)
    return refused.unionByName(
        rows.unionByName(waiting).coalesce(1).sortWithinPartitions(F.asc_nulls_first("seq"))
        .mapInArrow(_refused_in_order, "seq bigint"))


def apply_checked_changes(t: Tables, table: str, changes: DataFrame,
                          in_order: int = IN_ORDER) -> tuple[Tables, DataFrame]:
    """Upserts and deletes as a database that keeps the declared rules takes them one by one.

    ``changes``: the columns of the table plus ``op`` ('upsert' or 'delete') and ``seq`` (bigint,
    unique, not null). Gives the snapshot after the batch and the refused changes (seq, key, op,
    reason). A change is refused when it breaks a rule of its row, names a parent that is not there,
    deletes a row that a reference without cascade uses, or asks for a unique value that another row
    holds at its turn; a value that an earlier accepted change set free may be taken. A refused
    change has no effect. A delete takes the rows that depend on it along; deleting a key that is not
    there does nothing. References are judged against the snapshot before the batch.

    Changes that share no key and no unique value with a waiting earlier one are decided together; at
    most ``in_order`` that are left after a round are read in order by one task, with the rows whose
    values they touch.
    """
    key, unique = KEY[table], UNIQUE.get(table, ())
    judged = checkpointed(_rule_reasons(t, table, changes))
    fair = judged.where("reason IS NULL").drop("reason")
    refused = judged.where("reason IS NOT NULL").select("seq", key, "op", "reason")
    if unique:
        doubles = checkpointed(_doubles(t[table], fair, key, unique, in_order))
        refused = refused.unionByName(fair.join(doubles, "seq", "left_semi").select(
            "seq", key, "op", F.lit(f"duplicate {' or '.join(unique)}").alias("reason")))
        fair = fair.join(doubles, "seq", "left_anti")
    deleted = fair.where("op = 'delete'").select(key)
    after = cascade_delete(t, table, deleted)
    return after.replace(**{table: apply_changes(t[table], fair, key)}), refused


def cascade_delete(t: Tables, table: str, ids: DataFrame) -> Tables:
    """Delete parents by key together with everything that depends on them.

    A parent is kept when a table whose reference does not cascade still points at it (a
    customer with loans, a loan type in use, a band in use).
    """
    key = KEY[table]
    doomed = ids.select(F.col(ids.columns[0]).alias(key)).distinct()
    for ref in REFERENCES:
        if ref.parent == table and not ref.cascades:
            used = t[ref.child].select(F.col(ref.column).alias(key)).distinct()
            doomed = doomed.join(used, key, "left_anti")
    gone: dict[str, DataFrame] = {table: doomed}
    left = {table: t[table].join(doomed, key, "left_anti").select(*t[table].columns)}
    parents = {r.parent for r in REFERENCES if r.cascades}
    for ref in REFERENCES:          # listed parents first, so one pass reaches every level
        if ref.cascades and ref.parent in gone:
            child = t[ref.child]
            parent = gone[ref.parent].select(F.col(KEY[ref.parent]).alias(ref.column))
            left[ref.child] = child.join(parent, ref.column, "left_anti").select(*child.columns)
            if ref.child in parents:  # its keys are only needed where something hangs on them
                gone[ref.child] = child.join(parent, ref.column, "left_semi").select(KEY[ref.child])
    return t.replace(**left)


# --- counters and timelines ------------------------------------------------------------------

def credit_history_rollup(t: Tables) -> DataFrame:
    """Loan and default counters recomputed from the loans, beside the stored ones."""
    defaults = t.default_record.groupBy("loan_id").agg(F.count("*").alias("defaults"))
    actual = (t.loan.select("loan_id", "customer_id").join(defaults, "loan_id", "left")
              .groupBy("customer_id").agg(
                  F.count("*").alias("actual_loans"),
                  F.coalesce(F.sum("defaults"), F.lit(0)).alias("actual_defaults")))
    stored = t.credit_history.groupBy("customer_id").agg(
        F.sum("total_loans").alias("stored_loans"),
        F.sum("total_defaults").alias("stored_defaults"))
    both = stored.join(actual, "customer_id", "full").fillna(
        0, ["stored_loans", "stored_defaults", "actual_loans", "actual_defaults"])
    return both.select(
        "customer_id", "stored_loans", "actual_loans", "stored_defaults", "actual_defaults",
        ((F.col("stored_loans") != F.col("actual_loans"))
         | (F.col("stored_defaults") != F.col("actual_defaults"))).alias("drifted"))


def status_timeline(t: Tables, blocks: int | None = None) -> DataFrame:
    """Status changes of every loan in order, with the status before and the days between."""
    return look_back(
        t.loan_status_history, "loan_id", "change_date", "status_history_id",
        {"previous_status": lambda w: F.lag("status_label").over(w),
         "days_since_previous":
             lambda w: F.datediff("change_date", F.lag("change_date").over(w))},
        reach=1, blocks=blocks)


# --- validation ------------------------------------------------------------------------------

def _row_rules(table: str) -> dict[str, str]:
    """Conditions, as SQL, that a bad row of the table meets."""
    rules: dict[str, str] = {}
    references = [r.column for r in REFERENCES if r.child == table and not r.nullable]
    for column in (KEY[table], *references, *REQUIRED.get(table, ())):
        rules[f"{column} not null"] = f"{column} IS NULL"
    for name, condition in CHECKS.get(table, {}).items():
        rules[name] = f"NOT ({condition})"
    for (owner, column), words in DOMAINS.items():
        if owner == table:
            rules[f"{column} in domain"] = f"{column} NOT IN {words}"
    for column, longest in MAX_LENGTH.get(table, {}).items():
        rules[f"{column} length"] = f"length({column}) > {longest}"
    return rules


def _counts(*named: str) -> list[Column]:
    return [F.expr(text) for text in named]


def _as_rows(counted: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """One row (table_name, rule, n) for each (table, rule), counted in columns r0, r1, ..."""
    entries = ", ".join(f"struct('{owner}' AS table_name, '{rule}' AS rule, "
                        f"coalesce(r{i}, 0L) AS n)" for i, (owner, rule) in enumerate(rules))
    return counted.selectExpr(f"inline(array({entries}))")


def _row_violations(t: Tables, table: str) -> DataFrame:
    """All row rules of a table, counted in one pass over it."""
    rules = _row_rules(table)
    counted = t[table].agg(*_counts(*[f"count_if({bad}) AS r{i}"
                                      for i, bad in enumerate(rules.values())]))
    return _as_rows(counted, [(table, rule) for rule in rules])


def _key_violations(t: Tables, parent: str) -> DataFrame:
    """Repeated keys of a table and orphans in every table that refers to it.

    Parent keys and references are stacked and counted by key: one shuffle of combined counts
    answers all rules about the key, and no key is ever a hot join key.
    """
    key = KEY[parent]
    references = [r for r in REFERENCES if r.parent == parent]
    marked = [t[parent].selectExpr(f"{key} AS _key", "0 AS _from")]
    marked += [t[r.child].selectExpr(f"{r.column} AS _key", f"{i} AS _from")
               for i, r in enumerate(references, 1)]
    children = range(1, len(marked))
    per_key = (reduce(DataFrame.unionByName, marked).where("_key IS NOT NULL").groupBy("_key")
               .agg(*_counts("count_if(_from = 0) AS k0",
                             *[f"count_if(_from = {i}) AS k{i}" for i in children])))
    counted = per_key.agg(*_counts(
        "count_if(k0 > 1) AS r0",
        *[f"sum(CASE WHEN k0 = 0 THEN k{i} END) AS r{i}" for i in children]))
    return _as_rows(counted, [
        (parent, f"{key} unique"),
        *[(r.child, f"{r.column} refers to {parent}") for r in references]])


def _repeated_values(t: Tables, table: str, column: str) -> DataFrame:
    repeated = (t[table].where(f"{column} IS NOT NULL").groupBy(column)
                .agg(*_counts("count(*) AS k")).agg(*_counts("count_if(k > 1) AS r0")))
    return _as_rows(repeated, [(table, f"{column} unique")])


def _band_mismatches(t: Tables) -> DataFrame:
    expected = score_bands(t.risk_category).withColumnRenamed("risk_id", "_expected")
    counted = (t.credit_score.select("score_value", "risk_id")
               .join(F.broadcast(expected), "score_value", "left")
               .agg(*_counts("count_if(NOT risk_id <=> _expected) AS r0")))
    return _as_rows(counted, [("credit_score", "risk_id fits score_value")])


def validate_tables(t: Tables) -> DataFrame:
    """Violations of every declared rule: (table_name, rule, n)."""
    parts = [_row_violations(t, table) for table in TABLES]
    parts += [_key_violations(t, table) for table in TABLES]
    parts += [_repeated_values(t, table, column)
              for table, columns in UNIQUE.items() for column in columns]
    return reduce(DataFrame.unionByName, [*parts, _band_mismatches(t)])


def _failed(rules: dict[str, Column]) -> Column:
    """The names of the failing rules joined by '; ', empty when all hold."""
    return F.concat_ws("; ", *[F.when(F.coalesce(bad, F.lit(True)), name)
                               for name, bad in rules.items()])


def _outside(column: str, limits: tuple) -> Column:
    return ~F.col(column).between(*limits)


def application_input_checks(t: Tables, applications: DataFrame) -> DataFrame:
    """Applications with the entry rules they break (form limits and the type's maximum)."""
    limits = t.loan_type.select("loan_type_id", "max_amount")
    rows = applications.join(limits, "loan_type_id", "left")
    problems = _failed({
        "unknown loan type": F.col("max_amount").isNull(),
        "amount out of range": _outside("loan_amount", (F.lit(LOAN_AMOUNT_MIN),
                                                        F.col("max_amount"))),
        "tenure not offered": ~F.col("tenure").isin(*TENURES),
        "rate out of range": _outside("interest_rate", RATE_RANGE),
    })
    return rows.select("application_id", problems.alias("problems"))


def payment_input_checks(t: Tables, payments: DataFrame) -> DataFrame:
    """Payments with the entry rules they break (0.01 up to 1.5 times the instalment)."""
    rows = payments.join(t.emi_schedule.select("emi_id", "emi_amount"), "emi_id", "left")
    most = F.col("emi_amount") * F.lit(PAYMENT_MAX_FACTOR).cast("decimal(2,1)")
    problems = _failed({
        "unknown instalment": F.col("emi_amount").isNull(),
        "amount out of range": ~F.col("paid_amount").between(
            F.lit(PAYMENT_MIN).cast("decimal(12,2)"), most),
        "unknown mode": ~F.col("payment_mode").isin(*DOMAINS[("repayment", "payment_mode")]),
    })
    return rows.select("request_id", problems.alias("problems"))


def loan_type_input_checks(loan_types: DataFrame) -> DataFrame:
    problems = _failed({
        "name required": blank_to_null(F.col("type_name")).isNull(),
        "rate out of range": _outside("base_interest_rate", TYPE_RATE_RANGE),
        "maximum out of range": _outside("max_amount", TYPE_AMOUNT_RANGE),
    })
    return loan_types.select("loan_type_id", problems.alias("problems"))


def risk_band_input_checks(bands: DataFrame) -> DataFrame:
    problems = _failed({
        "min_score out of range": _outside("min_score", BAND_MIN_RANGE),
        "max_score out of range": _outside("max_score", BAND_MAX_RANGE),
    })
    return bands.select("risk_id", problems.alias("problems"))


def registration_input_checks(batch: DataFrame) -> DataFrame:
    """Registration requests with the entry rules they break."""
    born = tuple(F.lit(d).cast("date") for d in BIRTH_RANGE)
    kinds = DOMAINS[("income_details", "employment_type")]
    problems = _failed({
        **{f"{c} required": blank_to_null(F.col(c)).isNull() for c in ("name", *CONTACTS)},
        "birth date out of range": _outside("dob", born),
        "income out of range": _outside("monthly_income", INCOME_RANGE),
        "unknown employment": ~F.col("employment_type").isin(*kinds),
    })
    return batch.select("request_id", problems.alias("problems"))
