"""Row-at-a-time model of the lifecycle for property tests."""

import pandas as pd

from decantry.functions import exprs as X


def reference_fold(history: list[dict]) -> tuple[dict, dict]:
    """Row-at-a-time model of the reference for tests: events in (ts, seq) order, each a status
    change ``{order_id, customer_id, status, ts, created_at, order_number, perfumes}`` or a
    manual change ``{kind: "manual", customer_id, perfume, unlocked, ts}``.
    Returns (library {(c,p): source}, notifications {(c,p,o): ts}; o is None for manual ones)."""
    status: dict = {}
    delivered_at: dict = {}
    library: dict = {}
    notes: dict = {}
    meta = {}
    for e in history:
        if e.get("kind") == "manual":
            c, p = e["customer_id"], e["perfume"].strip()
            if e["unlocked"]:
                library.setdefault((c, p), X.MANUAL_SOURCE)
                if not any(k[0] == c and k[1] == p for k in notes):
                    notes[(c, p, None)] = e["ts"]
            else:
                library.pop((c, p), None)
                for k in [k for k in notes if k[0] == c and k[1] == p]:
                    del notes[k]
            continue
        o = e["order_id"]
        meta[o] = e
        prev = status.get(o, "pending")
        c = e["customer_id"]
        if prev == "delivered" and e["status"] != "delivered" and c is not None:
            for p in {x.strip() for x in e["perfumes"] if x and x.strip()}:
                if library.get((c, p)) == "ORDER-" + e["order_number"]:
                    cands = [q for q, st in status.items() if q != o and st == "delivered"
                             and meta[q]["customer_id"] == c
                             and p in {x.strip() for x in meta[q]["perfumes"] if x}]
                    if cands:
                        best = max(cands, key=lambda q: (delivered_at.get(q) is not None,
                                                         delivered_at.get(q) or pd.Timestamp.min,
                                                         meta[q]["created_at"], meta[q]["order_number"]))
                        library[(c, p)] = "ORDER-" + meta[best]["order_number"]
                    else:
                        del library[(c, p)]
            for k in [k for k in notes if k[2] == o]:
                del notes[k]
        if e["status"] == "delivered":
            if prev != "delivered":
                delivered_at[o] = e["ts"]
        else:
            delivered_at[o] = None
        status[o] = e["status"]
        if e["status"] == "delivered" and prev != "delivered" and c is not None:
            for p in {x.strip() for x in e["perfumes"] if x and x.strip()}:
                if (c, p) not in library:
                    library[(c, p)] = "ORDER-" + e["order_number"]
                    notes[(c, p, o)] = e["ts"]
    return library, notes
