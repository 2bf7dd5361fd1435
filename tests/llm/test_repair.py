"""Repair of conversations against a search over all edits."""

import hashlib
import random
import re
import zlib
from functools import lru_cache

import pytest

from slatewright.llm import repair

SCHEMA = "conv_id long, turn int, role string, text string"


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        spaced = lambda v: " " if v is None else str(v)
        k = zlib.crc32(f"{spaced(conv)}:{spaced(turn)}".encode()) % 20
        role, text = spaced(role), spaced(text)
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        out += [(conv, turn, "user" if k == 4 else role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
    return out


def brute(rows):
    after, out = damaged(rows), []
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in after if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        turns = [r[1] for r in own if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        seen, fault = set(), []
        for _, _, role, text in own:
            bare = text.rstrip(" \t\n\v\f\r")
            fault.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:], strict=False))
        follow = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

        @lru_cache(None)
        def best(i, state, inserted):
            found = []
            if i == len(own) and state in ("", "a"):
                found.append((0, "", ()))
            if inserted < 3:
                for role in ("user", "assistant"):
                    if (state, role[0]) in follow:
                        found.append((2, "I", (f"{role}:",), (i, role[0], inserted + 1)))
            if i < len(own):
                _, _, role, text = own[i]
                found.append((3, "D", (), (i + 1, state, 0)))
                if fault[i] not in ("blank", "duplicate"):
                    extra = fault[i] == "truncated"
                    if (state, role[:1]) in follow:
                        found.append((extra, "K", (f"{role}:{text}",), (i + 1, role[0], 0)))
                    found += [(2 + extra, "R", (f"{new}:{text}",), (i + 1, new[0], 0)) for new in ("user", "assistant") if (state, new[0]) in follow]
            done = []
            for cost, letter, lines, *rest in found:
                tail = best(*rest[0]) if rest else (0, "", ())
                if tail is not None:
                    done.append((cost + tail[0], letter + tail[1], lines + tail[2]))
            return min(done, key=lambda x: x[:2]) if done else None

        for i in range(len(own), 0, -1):  # from the end, so that recursion stays shallow
            for state in ("", "s", "u", "a"):
                best(i, state, 0)
        cost, audit, lines = best(0, "", 0)
        out.append((conv, gaps, fault.count("blank"), fault.count("duplicate"), fault.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def repaired(spark, rows, schema=SCHEMA):
    found = repair.report(spark, spark.createDataFrame(rows, schema))
    assert found.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    return sorted((tuple(r) for r in found.collect()), key=str)


def made(n, seed, longest=9):
    rng, rows = random.Random(seed), []
    for conv in range(n):
        turn = rng.randrange(3)
        for _ in range(rng.randrange(1, longest)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "Assistant", "", None])
            text = rng.choice(["Yes.", "No", "Well then?", " \t", "", None, "ok.\n", f"Say {rng.random()}!", "same."])
            rows.append((conv, None if rng.random() < 0.1 else turn, role, text))
            turn += rng.choice([0, 1, 1, 1, 2, 5])
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_equal_to_a_search_over_all_edits(spark, seed):
    rows = made(250, seed)
    random.Random(seed).shuffle(rows)
    assert repaired(spark, rows) == brute(rows)


def test_pieces_of_long_conversations(spark, monkeypatch):
    monkeypatch.setattr(repair, "PIECE", 3)
    rows = made(40, 3, 40)
    got = repair.report(spark, spark.createDataFrame(rows, SCHEMA))
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows)


def test_one_conversation_over_all_partitions(spark):
    rng = random.Random(4)
    rows = [(7, k, rng.choice(["user", "assistant", "system"]), rng.choice(["a.", "b", f"{k} c.", ""])) for k in range(900)]
    assert repaired(spark, rows + made(5, 5)) == brute(rows + made(5, 5))


def test_pieces_and_whole_conversations_agree():
    import numpy as np

    rng = random.Random(6)
    for _ in range(200):
        kinds = np.array([rng.randrange(4) | rng.choice([0, 0, 4, 8, 16]) for _ in range(rng.randrange(1, 12))])
        cost, audit, _ = repair.solve([(kinds, ["r"] * len(kinds), ["t"] * len(kinds))])[0]
        cut = rng.randrange(len(kinds) + 1)
        unit = np.where(np.eye(4, dtype=bool), 0, repair.FAR)
        after = repair.backward(kinds[cut:, None], repair.END[None])[0, 0]
        before = repair.backward(np.repeat(kinds[:cut, None], 4, axis=1), unit)[0].T
        assert int((before + after).min(axis=1)[0]) == cost
        letters, _, _, state = repair.trace(kinds[:cut, None], repair.backward(kinds[:cut, None], after[None]), np.array([0]), np.array([False]))
        rest, *_ = repair.trace(kinds[cut:, None], repair.backward(kinds[cut:, None], repair.END[None]), state, np.array([True]))
        assert "".join(repair.LETTERS[x] for x in [*letters[:, 0], *rest[:, 0]] if x >= 0) == audit


def test_odd_rows(spark):
    rows = [(None, 0, "user", "Hi."), (None, None, None, None), (1, None, "user", "x" * 300_000), (1, 0, "assistant", "y" * 300_000 + "."), (2, 3, "user", "É漢字🎉?"), (2, 3, "user", "É漢字🎉?"), (3, 5, "s", "S."), (-1, 0, "user", "q.")]
    rows += [(i, 0, "user", "gone.") for i in range(100, 160)]  # of some no row is left
    assert repaired(spark, rows) == brute(rows)
    wide = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA + ", ord long, k string")
    assert sorted((tuple(r) for r in repair.report(spark, wide).collect()), key=str) == brute(rows)
    assert any(r[7] == "" and r[8] == hashlib.sha256(b"").hexdigest() for r in brute(rows))


def test_empty_table(spark):
    assert repaired(spark, []) == []
