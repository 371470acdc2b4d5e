"""Conversation repair against a search of all edit scripts, and a plain dynamic programme over strings."""

import hashlib
import re
import zlib
from functools import lru_cache

import numpy as np
import pytest

from llm import conversations as C

PATTERN = re.compile(r"(s?(ua)+)?")


def searched(rows):
    """The least of all edit scripts with at most two rows inserted at a place: (cost, audit, repaired rows)."""
    out = [(0, "", ())]

    def grow(some):
        more = some
        for _ in range(2):
            more = [(c + 2, a + "I", r + ((x, ""),)) for c, a, r in more for x in ("user", "assistant")]
            some = some + more
        return list(dict.fromkeys(some))

    for role, text, fault in rows:
        out, now = grow(out), []
        for c, a, r in out:
            now.append((c + 3, a + "D", r))
            if fault not in (C.BLANK, C.DUPLICATE):
                cut = fault == C.CUT
                now.append((c + cut, a + "K", r + ((role, text),)))
                now += [(c + 2 + cut, a + "R", r + ((x, text),)) for x in ("user", "assistant")]
        out = now
    return min((c, a, r) for c, a, r in grow(out) if PATTERN.fullmatch("".join(x[:1] or "?" for x, _ in r)))


def plain(rows):
    """The least (cost, audit) from the end, over whole strings."""
    steps = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}

    def best(i, q, depth):
        found = [(0, "", ())] if i == len(rows) and q in (0, 3) else []
        if depth < 2:
            for x in ("user", "assistant"):
                if q in steps[x[0]]:
                    c, a, r = memo(i, steps[x[0]][q], depth + 1)
                    found.append((c + 2, "I" + a, ((x, ""),) + r))
        if i < len(rows):
            role, text, fault = rows[i]
            c, a, r = memo(i + 1, q, 0)
            found.append((c + 3, "D" + a, r))
            if fault not in (C.BLANK, C.DUPLICATE):
                cut = fault == C.CUT
                for edit, x, more in (("K", role, 0), ("R", "user", 2), ("R", "assistant", 2)):
                    if q in steps.get(x[:1], {}):
                        c, a, r = memo(i + 1, steps[x[:1]][q], 0)
                        found.append((c + cut + more, edit + a, ((x, text),) + r))
        return min(found, key=lambda f: f[:2], default=(10**9, "", ()))

    memo = lru_cache(None)(best)
    return memo(0, 0, 0)


def digest(rows):
    return hashlib.sha256("\n".join(f"{r}:{t}" for r, t in rows).encode()).hexdigest()


def random_rows(rng, n):
    roles = ["system", "user", "assistant", "tool", ""]
    return [(roles[k], f"t{i}.", int(f)) for i, (k, f) in enumerate(zip(rng.choice(5, n, p=[0.15, 0.38, 0.37, 0.06, 0.04]), rng.choice(4, n, p=[0.6, 0.1, 0.1, 0.2])))]


def repaired(rows):
    one = C.Repair()
    for k, (role, text, fault) in enumerate(rows):
        one.row(k, role, text, fault)
    return one.report()


def test_short_conversations_equal_a_search_of_all_scripts():
    rng = np.random.default_rng(1)
    for _ in range(40):
        rows = random_rows(rng, int(rng.integers(0, 4)))
        cost, audit, left = searched(rows)
        assert repaired(rows)[5:] == (cost, audit if rows else "", digest(left))
        assert plain(rows)[:2] == (cost, audit)


@pytest.mark.parametrize("settle", [1, 7, 4096])
def test_long_conversations_equal_a_plain_programme(monkeypatch, settle):
    monkeypatch.setattr(C, "SETTLE", settle)
    rng = np.random.default_rng(settle)
    for n in (20, 60, 120):
        for _ in range(4):
            rows = random_rows(rng, n)
            cost, audit, left = plain(rows)
            assert repaired(rows)[5:] == (cost, audit, digest(left))


def test_collisions_of_hashes_do_not_change_the_audit(monkeypatch):
    monkeypatch.setattr(C, "_MOD", 3)
    rng = np.random.default_rng(9)
    for _ in range(30):
        rows = random_rows(rng, 40)
        assert repaired(rows)[5:7] == plain(rows)[:2]


def brute(rows):
    """conv_id -> report, from rows (conv_id, turn, role, text) before damage."""
    kept = {}
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        own = kept.setdefault(conv, [])
        how = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if how:
            text = "" if how == 1 else re.sub("[.!?]", "", text) if how == 2 else text
            own += [(turn, "user" if how == 4 else role, text)] * (2 if how == 3 else 1)
    out = {}
    for conv, own in kept.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, faults = set(), []
        for _, role, text in own:
            t = text.rstrip(" \t\n\x0b\x0c\r")
            faults.append(C.BLANK if not t else C.DUPLICATE if (role, text) in seen else C.CUT if t[-1] not in ".!?" else C.NO_FAULT)
            seen.add((role, text))
        turns = [t for t, _, _ in own if t is not None]
        cost, audit, left = plain([(r, t, f) for (_, r, t), f in zip(own, faults)])
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, *[faults.count(f) for f in (C.BLANK, C.DUPLICATE, C.CUT)], illegal, cost, audit if own else "", digest(left))
    return out


def odd_rows():
    rng = np.random.default_rng(4)
    rows = [(c, t, ["system", "user", "assistant"][int(rng.integers(0, 3))], f"Text {int(rng.integers(0, 4))} of it{'.!?, '[int(rng.integers(0, 5))]}") for c in range(120) for t in range(int(rng.integers(1, 12)))]
    rows += [(500, None, "user", "No turn."), (500, None, None, None), (500, 3, "user", "é?\x0b"), (500, 9, "assistant", "a "), (None, 1, "user", "x."), (None, 2, "assistant", "y!"), (501, None, "user", "A.")]
    rows += [rows[5], rows[5], rows[6]]
    rows += [(600, t, "user" if t % 2 else "assistant", f"line {t}. " + "long " * 300_000 * (t == 3) + ".") for t in range(6)]
    rows.append((next(c for c in range(1000, 2000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0), 0, "user", "Gone."))
    return rows


def test_reports_equal_brute_force(spark):
    rows = odd_rows()
    d = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, audit string").repartition(5)
    got = {r["conv_id"]: tuple(r)[1:] for r in C.repair(C.damaged(d), d).collect()}
    want = brute(rows)
    assert set(got) == set(want)
    for k in want:
        assert got[k] == want[k], k


def test_repaired_rows_have_the_digest_of_the_report(spark):
    d = C.damaged(spark.createDataFrame(odd_rows(), "conv_id long, turn long, role string, text string"))
    reports = C.repair(d)
    left = {}
    for r in C.repaired(d, reports).orderBy("conv_id", "position").collect():
        left.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    for r in reports.collect():
        assert digest(left.get(r["conv_id"], [])) == r["repaired_sha256"]


def test_the_whole_table_and_an_empty_one(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r["conv_id"]: tuple(r)[1:] for r in C.op12_conversations(spark, sf).collect()}
    assert got == brute(rows)
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert C.repair(C.damaged(none), none).count() == 0
