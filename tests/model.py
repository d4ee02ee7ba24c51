"""Plain Python models of the results, written from their definitions; they share no code with the library."""

import json
from collections import defaultdict


def key(x):
    return None if x is None or not x.strip() else x.strip().lower()


def versions(rows):
    """rows: (id, status, at, seq) -> {(id, status, from, to)}."""
    best = {}
    for i, s, t, q in rows:
        if key(i) and key(s) and t is not None:
            k = (key(i), t)
            best[k] = max(best.get(k, (-1, "")), (q, key(s)))
    per = defaultdict(list)
    for (i, t), (_, s) in sorted(best.items()):
        if not per[i] or per[i][-1][0] != s:
            per[i].append((s, t))
    out = set()
    for i, l in per.items():
        for k, (s, t) in enumerate(l):
            out.add((i, s, t, l[k + 1][1] if k + 1 < len(l) else -1))
    return out


def _decoded(x):
    if isinstance(x, str):
        try:
            y = json.loads(x)
        except ValueError:
            return x
        return y if isinstance(y, (dict, list)) else x
    return x


def _document(text):
    try:
        return _decoded(json.loads(text)) if text else None
    except ValueError:
        return None


def nested(candidates, frontier):
    """candidates: (seq, patch, runs); frontier: (id, champions, archive)."""
    out = set()
    for seq, patch, runs in candidates:
        if runs is not None:
            out.add(("stability", str(seq), "runs", str(runs)))
        doc = _document(patch)
        if not isinstance(doc, dict):
            continue
        model = _decoded(doc.get("model"))
        entries = [(str(k), _decoded(e)) for k, e in enumerate(model)] if isinstance(model, list) else [("0", model)]
        for k, e in entries:
            if isinstance(e, dict) and isinstance(e.get("type"), str):
                out.add(("model", str(seq), k, e["type"]))
        if isinstance(doc.get("model.type"), str):
            out.add(("model", str(seq), "0", doc["model.type"]))
    for sid, champions, archive in frontier:
        doc = _document(champions)
        pairs = doc.items() if isinstance(doc, dict) else [(e.get("family"), e) for e in doc or [] if isinstance(e, dict)]
        for family, e in pairs:
            if isinstance(e, dict) and isinstance(e.get("candidate_id"), str) and family is not None:
                out.add(("family_champion", str(sid), family, e["candidate_id"]))
        doc = _document(archive)
        if not isinstance(doc, dict):
            continue
        lists = [("global", doc.get("global"))] + [(f"families/{f}", l) for f, l in (doc.get("families") or {}).items()]
        for where, entries in lists:
            for k, e in enumerate(entries or []):
                child = f"{where}/{k}"
                if isinstance(e.get("candidate_id"), str):
                    out.add(("elite", str(sid), child, e["candidate_id"]))
                for name, t in (e.get("prediction_scores") or {}).items():
                    d = t.get("decisive") if isinstance(t, dict) else None
                    out.add(("elite_test", f"{sid}/{child}", name, "" if d is None else str(d).lower()))
    return out


def tree(links):
    """links: {id: parent or None} -> {(id, root, depth, descendants, state)}."""
    up = {i: p if p in links else None for i, p in links.items()}
    ring, kind = set(), {}
    for i in up:
        seen, x = {}, i
        while x is not None and x not in seen:
            seen[x] = len(seen)
            x = up[x]
        if x is not None:
            ring |= {y for y, k in seen.items() if k >= seen[x]}
            kind[i] = 2
    below = defaultdict(int)
    for i in up:
        x, seen = up[i], {i}
        while x is not None and x not in seen:
            below[x] += 1
            seen.add(x)
            x = up[x]
    out = set()
    for i in up:
        if i in ring:
            out.add((i, "", -1, -1, 1))
        elif i in kind:
            out.add((i, "", -1, below[i], 2))
        else:
            d, x = 0, i
            while up[x] is not None:
                d, x = d + 1, up[x]
            out.add((i, x, d, below[i], 0))
    return out
