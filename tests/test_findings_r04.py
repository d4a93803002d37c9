"""What a review found: a stream's state is not asked code by code."""

import json
import random

import pandas as pd

from ledgerlark.streaming import crosswalk, golden

RULES = crosswalk.Rules(golden.Entity(("name", "city", "tel"), {"crm": ("name", "city"), "shop": ("name", "city"), "shop.tel": ("tel",)}, "crm", ("name",)), ("name",))
INBOX = ["root", "system", "code", "seq", "row_kind", "source_ms", "row", "unmapped"]


class _Map:
    """A map state that counts what it is asked."""

    def __init__(self):
        self.now, self.asked = {}, 0

    def exists(self):
        self.asked += 1
        return bool(self.now)

    def getValue(self, k):  # noqa: N802
        self.asked += 1
        return self.now.get(k)

    def updateValue(self, k, v):  # noqa: N802
        self.asked += 1
        self.now[k] = v

    def removeKey(self, k):  # noqa: N802
        self.asked += 1
        self.now.pop(k, None)


class _Pages:
    """A processor with a state a page, as a stream runs it."""

    def __init__(self, processor, by, pages):
        self.processor, self.by, self.pages, self.states = processor, by, pages, {}

    def batch(self, rows):
        out, of = [], {}
        for r in rows.to_dict("records"):
            of.setdefault(sum(map(ord, "".join(str(r[c]) for c in self.by))) % self.pages, []).append(r)
        for page, mine in of.items():
            state = self.states.setdefault(page, _Map())
            self.processor.init(type("H", (), {"getMapState": lambda self, *_: state})())
            out += list(self.processor.handleInputRows((page,), iter([pd.DataFrame(mine, columns=rows.columns, dtype=object)]), None))
        return pd.concat(out)


def test_a_page_of_codes_asks_the_state_slot_by_slot():
    """crosswalk_streamed: one call a code and family, each with states of its own, took most of the time."""
    n = 2000
    crm = pd.DataFrame([("crm", "crm", f"c{i}", i, "INSERT", i, json.dumps({"name": f"n{i}", "city": "x"}), None) for i in range(n)], columns=INBOX)
    shop = pd.DataFrame([("shop", "shop", f"s{i}", n + i, "INSERT", n + i, json.dumps({"name": f"n{i}", "city": "x"}), None) for i in range(n)], columns=INBOX)
    first, second = _Pages(crosswalk._Routing(RULES, 4), ("root", "code"), 1), _Pages(crosswalk._Settling(RULES, 4), ("family",), 1)
    assert set(second.batch(first.batch(crm)).outcome) == {"created"} and set(second.batch(first.batch(shop)).outcome) == {"echo"}
    assert first.states[0].asked <= 2 + 2 * 8 and second.states[0].asked <= 2 + 2 * 2 * 12
    assert len(first.states[0].now) == 8 and len(second.states[0].now) == 12


def test_pages_and_slots_change_no_row():
    """Rows in batches through pages with few slots, as one by one through plain dicts; codes are null, empty or have line breaks."""
    r = random.Random(7)
    rows = []
    for i in range(600):
        system = r.choice(["crm", "shop", "shop.tel"])
        kind = r.choice(["INSERT", "INSERT", "UPDATE_AFTER", "UPDATE_BEFORE", "DELETE", "LINK"]) if system != "shop.tel" else r.choice(["INSERT", "DELETE"])
        told = {"tel": str(r.randrange(3))} if system == "shop.tel" else {"name": r.choice(["Ada", "Bob\nBee", "Eve|", None]), "city": r.choice(["x", "ÿ"])}
        code = r.choice([None, "", "None", "a\nb", "a|b", *"12345678"])
        rows.append((system.split(".")[0], system, code, i, kind, 1000 * i, json.dumps({"key": r.choice([None, None, "f\ng:1"])} if kind == "LINK" else told), r.choice([None, '["city"]'])))
    codes, families, want = {}, {}, []
    for row in (dict(zip(INBOX, x, strict=True)) for x in rows):
        for x in crosswalk._numbered(crosswalk.route(codes.setdefault((row["root"], row["code"]), crosswalk.Code()), RULES, row), row):
            routed = dict(zip(crosswalk._ROUTED, x, strict=True))
            want += crosswalk.settle(families.setdefault(routed["family"], crosswalk.Family({}, {}, {}, {})), RULES, routed)
    for pages, slots in ((1, 1), (3, 2)):
        first, second = _Pages(crosswalk._Routing(RULES, slots), ("root", "code"), pages), _Pages(crosswalk._Settling(RULES, slots), ("family",), pages)
        got = [second.batch(first.batch(pd.DataFrame(rows[i : i + 150], columns=INBOX))) for i in range(0, 600, 150)]
        told = lambda cells: repr(tuple(None if c != c else int(c) if n == "rev" and c is not None else c for n, c in zip(crosswalk._OUT, cells, strict=True)))
        assert sorted(told(x) for pdf in got for x in pdf.itertuples(index=False)) == sorted(map(told, want))
