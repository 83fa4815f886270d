"""Set-wise product expansion and column arithmetic against plain versions."""

import math
import random
import re
from itertools import product

import pytest
from pyspark.sql import functions as F

from lakeloom.functions import arithmetic
from lakeloom.operators import expansion, rates


def test_expansion_of_many_requests(spark):
    """Every subset of the codes, by channel and client, as the one-request form says; then orders and repeats."""
    r = random.Random(3)
    codes = ["401", "502", "506", "524", "526", "528", "TDE", "FFD", "TMS", "529", "XX"]
    lists = [",".join(c for c, b in zip(codes, bits) if b) for bits in product((0, 1), repeat=len(codes))]
    lists += [", ".join(r.choices(codes, k=r.randrange(1, 9))) for _ in range(1500)] + [" ", ",", "TMS,TMS,401", "528,528 ,\tTDE"]
    rows = [(p, ch, cl) for p in lists for ch, cl in product(("ONLINE, COUNTER", "ONLINE", " COUNTER", "", "OTHER"), ("CN", "DN"))]
    d = spark.createDataFrame([(i, *x, "x") for i, x in enumerate(rows)], "id int, products string, channels string, client string, _r string")
    got = {x.id: x for x in expansion.expand_requests(d).collect()}
    for i, x in enumerate(rows):
        kept, interest = rates.expand_products(*x)
        assert (got[i].product_codes, got[i].interest_types) == (kept, interest), x
    assert got[0]._r == "x"


def test_consequences_of_expansion(spark):
    ask = [("528", "ONLINE, COUNTER", "CN"), ("", "ONLINE", "DN"), (None, None, None), (None, "COUNTER", "CN"), ("TMS,FFD,XX", "COUNTER", "DN"), ("TDE,FFD", "COUNTER", "DN"), ("TMS", "COUNTER", "CN")]
    d = spark.createDataFrame(ask, "products string, channels string, client string")
    got = [(x.product_codes, x.interest_types) for x in expansion.expand_requests(d).coalesce(1).collect()]
    assert got == [
        (["528"], ["ET3", "ET2"]),  # the 529 it queues goes, its interest type stays
        ([], []),  # the default of a business online has no rule
        ([], []),
        (["TDE"], ["TDE"]),
        (["TMS", "FFD", "XX"], ["TMS"]),  # what waits is not judged any more
        (["TDE", "FBM", "TMS"], ["TMS", "TMS"]),
        (["TMS", "TDE"], ["TDE", "TDE"]),
    ]
    with pytest.raises(ValueError, match="for ever"):
        expansion.expand_requests(d, rules={(True, "a"): expansion.Rule(queues="b"), (True, "b"): expansion.Rule(queues="a")})
    plan = expansion.expand_requests(d)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


class Number:
    """Doubles with // as the floor of the quotient."""

    def __init__(self, v):
        self.v = float(v)

    def __neg__(self):
        return Number(-self.v)

    def __pos__(self):
        return self

    def __add__(self, o):
        return Number(self.v + o.v)

    def __sub__(self, o):
        return Number(self.v - o.v)

    def __mul__(self, o):
        return Number(self.v * o.v)

    def __truediv__(self, o):
        return Number(self.v / o.v)

    def __floordiv__(self, o):
        return Number(math.floor(self.v / o.v))

    def __mod__(self, o):
        return self - o * (self // o)


def plain(text):
    if not text.strip() or not re.fullmatch(r"[-+*/%()0-9.\s]*", text) or "**" in text.replace(" ", ""):
        return None
    try:
        marked = re.sub(r"[0-9]+(\.[0-9]+)?", lambda m: f" Number({m[0]}) ", text.replace("\n", " "))
        if "." in re.sub(r"Number\([^)]*\)", "", marked):
            return None
        return eval(marked.strip(), {"Number": Number}).v  # noqa: S307  the test's own texts
    except (SyntaxError, ZeroDivisionError, TypeError, AttributeError, OverflowError):
        return None


def made(r, depth=0):
    kind = r.random()
    if depth > 4 or kind < 0.3:
        return r.choice(["3", "2.5", "10", "0", "7", "0.125"])
    if kind < 0.45:
        return f"({made(r, depth + 1)})"
    if kind < 0.6:
        return f"{r.choice('+-')}{made(r, depth + 1)}"
    return f"{made(r, depth + 1)}{r.choice(['+', '-', '*', '/', '//', '%', ' - ', ' * ', ' + '])}{made(r, depth + 1)}"


def test_arithmetic_over_a_column(spark):
    r = random.Random(5)
    texts = [made(r) for _ in range(2500)]
    broken = ["", " ", "()", "1 2", "1.", ".5", "1..2", "(1", "1)", "1+", "*2", "1 / / 2", "2 ** 3", "2**3", "a+1", "1;2", "1,2", "__import__('os')", "1e3", "(1)(2)", "2(3)", "(2)3", "1 . 5", ")1(", "7//0", "7%0", "1/0", "0/0+1", "--3", "- - 3", "((((5))))", "3 // 2", "-7 // 2", "-7 % 3", "7 % -3", "2 - 3 - 4", "2 / 4 / 8", "1\n+\t2"]
    texts += broken + [t[:k] for t in texts[:300] if (k := len(t) // 2)]
    d = spark.createDataFrame(list(enumerate([*texts, None])), "id int, t string").repartition(2)
    got = {x.id: x.v for x in d.select("id", arithmetic.evaluated(F.col("t")).alias("v")).collect()}
    for i, t in enumerate(texts):
        want = plain(t)
        assert (got[i] is None) == (want is None), (t, got[i], want)
        assert want is None or math.isclose(got[i], want, rel_tol=1e-9, abs_tol=1e-9), (t, got[i], want)
    assert got[len(texts)] is None
    plan = d.select(arithmetic.evaluated(F.col("t")))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan
