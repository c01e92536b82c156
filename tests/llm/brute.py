"""Plain restatements of the problems, for small inputs."""

from __future__ import annotations

import math
import re
import unicodedata


def _role(r):
    r = re.sub("[^a-z]", "", (r or "").lower())
    return "user" if r in ("user", "human") else "assistant" if r in ("assistant", "gpt", "bot") else "system" if r == "system" else "tool" if r in ("tool", "toolresult", "function") else "other"


def _full(t):
    return any(not c.isspace() and unicodedata.category(c) not in ("Cf", "Cc", "Zs") for c in t or "")


def conversations(rows):
    """[(session_id, pos, id)] of dicts of messagedict."""
    by = {}
    for r in rows:
        s = re.sub(r"\.jsonl$", "", (r["session_id"] or "").strip())
        if s and r["id"] is not None:
            by.setdefault(s, []).append(r)
    out = []
    for s, own in by.items():
        ids = {}
        torn = False
        for r in own:
            p = (r["parentid"] or "").strip() or None
            rnd = None if r["round"] is None or math.isnan(r["round"]) else r["round"]
            rank = (_full(r["content"]), r["ingested_at"])
            if r["id"] in ids:
                torn |= ids[r["id"]][0] != p
                if rank <= ids[r["id"]][4]:
                    continue
            ids[r["id"]] = (p, _role(r["role"]), rnd, _full(r["content"]), rank)
        if torn:
            continue
        if any(m[0] for m in ids.values()):
            roots = [i for i, m in ids.items() if not m[0]]
            kids = {}
            for i, m in ids.items():
                if m[0]:
                    kids.setdefault(m[0], []).append(i)
            if len(roots) != 1 or any(p not in ids or len(k) > 1 for p, k in kids.items()):
                continue
            order, at = [], roots[0]
            while at is not None and len(order) <= len(ids):
                order.append(at)
                at = kids.get(at, [None])[0]
            if len(order) != len(ids):
                continue
        else:
            rounds = {}
            for i, m in ids.items():
                rounds.setdefault(m[2], []).append((m[1], i))
            if None in rounds:
                continue
            zero = rounds.pop(0, [])
            if len(zero) > 1 or any(r != "system" for r, _ in zero) or sorted(rounds) != list(range(1, len(rounds) + 1)):
                continue
            if any(sorted(r for r, _ in x) != ["assistant", "user"] for x in rounds.values()):
                continue
            order = [i for _, i in zero] + [i for k in sorted(rounds) for _, i in sorted(rounds[k], key=lambda x: x[0] != "user")]
        fine, waiting, users = True, False, 0
        for i in order:
            _, role, _, full, _ = ids[i]
            if role == "user":
                fine &= full and not waiting
                waiting, users = True, users + 1
            elif role == "assistant" and full:
                waiting = False
        if fine and users and not waiting:
            out += [(s, k + 1, i) for k, i in enumerate(order)]
    return out
