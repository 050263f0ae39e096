"""Plain, unscaled versions of the pipeline's steps, for comparison on small fixtures."""

from collections import defaultdict

from strandloom.llm import linededup as ld

BLANK = " \t\n\x0b\x0c\r"


def tokens(line):
    out, w = [], ""
    for c in line + " ":
        if c in BLANK:
            out += [w] * bool(w)
            w = ""
        else:
            w += c
    return out


def dedup_lines(rows):
    """[(doc_id, text)] with distinct ids -> {doc_id: (text, n_lines, n_dropped)}"""
    lines = []
    for d, t in rows:
        for k, s in enumerate(t.split("\n") if t is not None else []):
            m = tuple("<*>" if any(c in "0123456789" for c in w) else w for w in tokens(s))
            if len(m) >= ld.MIN_TOKENS:
                lines.append((d, k, m))
    docs, cells, fields = defaultdict(set), defaultdict(set), {}
    for d, _, m in lines:
        docs[m].add(d)
    for m in docs:
        n = len(m)
        size = n if n < ld.FIELD_TOKENS else ld.FIELDS
        fields[m] = [m[i * n // size : (i + 1) * n // size] for i in range(size)]
        for i, f in enumerate(fields[m]):
            cells[n, m[: ld.LEAD], i, f].add(m)
    groups = defaultdict(list)
    for d, k, m in lines:
        same = [(i, f) for i, f in enumerate(fields[m]) if len(c := cells[len(m), m[: ld.LEAD], i, f]) > 1 and len(set().union(*(docs[x] for x in c))) > 1]
        wide = len(same) * ld.FIELDS >= ld.LEAST_CONSTANT * len(fields[m])
        groups[(len(m), m[: ld.LEAD], tuple(same)) if wide else m].append((d, k))
    drop = {x for members in groups.values() if len({d for d, _ in members}) > 1 for x in sorted(members)[1:]}
    out = {}
    for d, t in rows:
        parts = t.split("\n") if t is not None else []
        left = [p for k, p in enumerate(parts) if (d, k) not in drop]
        out[d] = ("\n".join(left) if t is not None else None, len(parts), len(parts) - len(left))
    return out
