"""Product codes and interest types of many requests at once, by a fold over each request's queue in the JVM."""

from __future__ import annotations

import json
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeloom.operators.rates import COUNTER, ONLINE, PERSONAL
from lakeloom.scratch import fresh


class Rule(NamedTuple):
    """What a code becomes: for requests online, else at the counter, else in any case; the interest
    types that a channel adds, the code that the counter queues, and whether the counter ends the work."""

    online: str | None = None
    counter: str | None = None
    always: str | None = None
    online_adds: str | None = None
    counter_adds: str | None = None
    queues: str | None = None
    ends: bool = False


#: Rules by client (personal or not) and code; a code without a rule goes.
RULES: dict[tuple[bool, str], Rule] = {
    (True, "401"): Rule(online="401", online_adds="SA1"),
    (True, "502"): Rule(counter="502", counter_adds="S"),
    (True, "506"): Rule(online="506"),
    (True, "524"): Rule(online="524", online_adds="IT1"),
    (True, "526"): Rule(counter="526", counter_adds="FT2"),
    (True, "528"): Rule(always="528", online_adds="ET3", counter_adds="ET2", queues="529"),
    (True, "TDE"): Rule(counter="TDE", counter_adds="TDE"),
    (True, "FFD"): Rule(counter="FFD"),
    (True, "TMS"): Rule(online="524", always="TMS", online_adds="IT1", counter_adds="TDE", queues="TDE"),
    (False, "TDE"): Rule(always="TDE", online_adds="IT8", counter_adds="TMS", queues="TMS"),
    (False, "FFD"): Rule(counter="FBM"),
    (False, "TMS"): Rule(counter="TMS", counter_adds="TMS", ends=True),
}
#: What a request without products asks for, by client and channel.
DEFAULTS = {(True, ONLINE): "524", (False, ONLINE): "588", (True, COUNTER): "TDE", (False, COUNTER): "TDE"}

_BLANKS = " \t\n\r\f\v"


def _longest(rules: dict[tuple[bool, str], Rule]) -> int:
    """How many codes one asked code can come to, itself included."""

    def chain(client: bool, code: str, seen: tuple[str, ...]) -> int:
        r = rules.get((client, code))
        if r is None or r.queues is None:
            return 1
        if r.queues in seen:
            raise ValueError(f"the rules queue {code} for ever")
        return 1 + chain(client, r.queues, (*seen, r.queues))

    return max(chain(*k, (k[1],)) for k in rules)


def _listed(text: Column) -> Column:
    return F.transform(F.split(text, ","), lambda x: F.btrim(x, F.lit(_BLANKS)))


def expand_requests(requests: DataFrame, products: str = "products", channels: str = "channels", client: str = "client", rules: dict[tuple[bool, str], Rule] = RULES) -> DataFrame:
    """requests with ``product_codes`` and ``interest_types``, arrays in the order the codes were judged.

    ``products`` and ``channels`` are comma-separated texts, null like empty; ``client`` is
    the personal one or any other, null included. A request without products asks for its
    client's defaults. Codes are judged one after another and may queue others behind all
    that wait; an ending rule takes over what waits unjudged. No shuffle, one expression a row.
    """
    asked = _listed(F.coalesce(F.col(channels), F.lit("")))
    personal = F.coalesce(F.col(client) == PERSONAL, F.lit(False))
    # struct fields instead of repeated expressions, which every step would evaluate anew
    about, waiting, end = (fresh(requests, c) for c in ("_r", "_w", "_e"))
    d = requests.withColumn(about, F.struct(F.array_contains(asked, ONLINE).alias("online"), F.array_contains(asked, COUNTER).alias("counter"), personal.alias("personal")))
    r = F.col(about)
    default = F.array_compact(F.array(*(F.when(r[side] & (r["personal"] == who), F.lit(DEFAULTS[who, name])) for side, name in (("online", ONLINE), ("counter", COUNTER)) for who in (True, False))))
    wanted = F.when(F.coalesce(F.col(products), F.lit("")) == "", default).otherwise(_listed(F.col(products)))
    known = {f"{int(who)}{code}": rule._asdict() for (who, code), rule in rules.items()}
    kind = "map<string,struct<online:string,counter:string,always:string,online_adds:string,counter_adds:string,queues:string,ends:boolean>>"
    table = F.from_json(F.lit(json.dumps(known)), kind)
    none = F.array().cast("array<string>")
    state = lambda waiting, at, kept, interest, done: F.struct(waiting.alias("waiting"), at.alias("at"), kept.alias("kept"), interest.alias("interest"), done.alias("done"))
    some = lambda *c: F.array_compact(F.array(*c))

    def judge(s: Column, _: Column) -> Column:
        code = F.get(s["waiting"], s["at"])
        rule = F.try_element_at(table, F.concat(r["personal"].cast("int").cast("string"), code))
        on, counter = F.when(r["online"], rule["online"]), F.when(r["counter"], rule["counter"])
        ends = r["counter"] & F.coalesce(rule["ends"], F.lit(False))
        kept = F.concat(s["kept"], some(F.coalesce(on, counter, rule["always"])), F.when(ends, F.slice(s["waiting"], s["at"] + 2, F.size(s["waiting"]))).otherwise(none))
        interest = F.concat(s["interest"], some(F.when(r["online"], rule["online_adds"]), F.when(r["counter"], rule["counter_adds"])))
        after = state(F.concat(s["waiting"], some(F.when(r["counter"], rule["queues"]))), s["at"] + 1, kept, interest, ends)
        return F.when(s["done"] | code.isNull(), s).otherwise(after)

    d = d.withColumn(waiting, wanted)
    steps = F.when(F.size(waiting) > 0, F.sequence(F.lit(1), F.size(waiting) * _longest(rules))).otherwise(F.array().cast("array<int>"))
    d = d.withColumn(end, F.aggregate(steps, state(F.col(waiting), F.lit(0), none, none, F.lit(False)), judge))
    return d.select(*requests.columns, F.col(end)["kept"].alias("product_codes"), F.col(end)["interest"].alias("interest_types"))
