"""Property test: item size/quantity parsing equals a plain-Python model of the rule
(keep [0-9.]; '' -> default; unparseable -> quarantine)."""

import re
from decimal import ROUND_HALF_UP, Decimal, InvalidOperation

from hypothesis import given, settings
from hypothesis import strategies as st

from decantry.operators.orders import typed_items

SIZE_CHARS = st.text(alphabet="0123456789. mlxML", max_size=8)
QTY = st.one_of(st.none(), st.text(alphabet="0123456789.-", max_size=4))


def _num(text):
    if not re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)", text):
        return None
    try:
        v = Decimal(text)
    except InvalidOperation:
        return None
    # Sizes and quantities are kept as decimal(18,4): 4 decimals, rounded half-up.
    v = v.quantize(Decimal("0.0001"), rounding=ROUND_HALF_UP)
    return v if abs(v) < Decimal(10) ** 14 else None


def _model(size, qty):
    digits = re.sub(r"[^0-9.]", "", size or "")
    ml_v = _num(digits) if digits else None
    bad = bool(digits) and ml_v is None
    q = None if qty in (None, "") else qty
    q_v = _num(q) if q is not None else None
    bad = bad or (q is not None and q_v is None)
    return (ml_v if ml_v is not None else Decimal(0), q_v if q_v is not None else Decimal(1), bad)


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(SIZE_CHARS, QTY), min_size=1, max_size=60))
def test_parsing_matches_model(spark, rows):
    df = spark.createDataFrame([(i, "n", s, q) for i, (s, q) in enumerate(rows)],
                               "order_id long, name string, size string, qty string")
    got = {r.order_id: (r.ml, r.qty_n, r.quarantine) for r in typed_items(df).collect()}
    for i, (s, q) in enumerate(rows):
        ml, qty, bad = _model(s, q)
        g_ml, g_qty, g_bad = got[i]
        assert g_bad == bad, (s, q, got[i])
        if not bad:
            assert g_ml == ml and g_qty == qty, (s, q, got[i])
