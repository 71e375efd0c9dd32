"""Plain versions, by definition and one pair or site at a time, of what the library computes in bulk."""

from __future__ import annotations

import collections
import math
import re

NEG = -(10**9)


def global_align(a, b, width, scores):
    """(match score of the last cell, CIGAR) of codes ``a`` and ``b`` by the textbook recurrence, cell by cell."""
    n, m, table = len(a), len(b), scores.table().tolist()
    above, below = min(width + max(n - m, 0), n), min(width + max(m - n, 0), m)
    inside = lambda i, j: 0 <= i <= n and i < j + above and (i > j - below or (i == 0 and j <= below))
    best, came = {(0, 0): (0, NEG, NEG)}, {}
    for j in range(m + 1):
        for i in range(n + 1):
            if (i == 0 and j == 0) or not inside(i, j):
                continue
            match, ins, gone = NEG, NEG, NEG
            if i and j and (i - 1, j - 1) in best:
                x = best[i - 1, j - 1]
                came[i, j, 0] = 0 if x[0] >= max(x[1], x[2]) else 1 if x[1] > x[0] and x[1] > x[2] else 2
                match = max(x) + table[b[j - 1]][a[i - 1]] if max(x) > NEG // 2 else NEG
            if j and (i, j - 1) in best:
                x, each = best[i, j - 1], scores.gap_end if i in (0, n) else scores.gap_extend
                came[i, j, 1] = 0 if x[0] - scores.gap_open > x[1] else 1
                ins = max(x[0] - scores.gap_open, x[1]) - each
            if i and (i - 1, j) in best:
                x, each = best[i - 1, j], scores.gap_end if j in (0, m) else scores.gap_extend
                came[i, j, 2] = 0 if x[0] - scores.gap_open > x[2] else 2
                gone = max(x[0] - scores.gap_open, x[2]) - each
            best[i, j] = (match, ins, gone)
    x = best[n, m]
    state = 0 if x[0] >= max(x[1], x[2]) else 1 if x[1] >= x[2] else 2
    i, j, steps = n, m, ""
    while i or j:
        steps = "MID"[state] + steps
        following = came[i, j, state]
        i, j, state = i - (state != 1), j - (state != 2), following
    return x[0], "".join(f"{len(s[0])}{s[0][0]}" for s in re.finditer(r"M+|I+|D+", steps))


def operations(cigar):
    return [(int(n), op) for n, op in re.findall(r"(\d+)([MIDNSH])", cigar)]


def gap_sites(reads, ref, scores, window=50):
    """{pos: (cons, gap_q, snp_q, rms_q, depth, allele1, allele2, n1, n2)} of reads (pos, cigar, seq, qualities, mapq) of one reference."""
    code = {c: i for i, c in enumerate("ACGT")}
    codes = lambda t: [code.get(c, 4) for c in t.upper()]
    covered, gaps, texts = collections.defaultdict(list), collections.defaultdict(set), collections.defaultdict(list)
    for k, (pos, cigar, seq, _, _) in enumerate(reads):
        x, y, ops = pos, 0, operations(cigar)
        for i, (n, op) in enumerate(ops):
            after = ops[i + 1] if i + 1 < len(ops) else (0, "")
            if op in "MD":
                for p in range(x, x + n):
                    size = (after[0] if after[1] == "I" else -after[0] if after[1] == "D" else 0) if op == "M" and p == x + n - 1 else 0
                    covered[p].append((k, size))
                    if size:
                        gaps[p].add(size)
                    if size > 0:
                        texts[p, size].append(seq[y + n : y + n + size])
            x, y = x + n * (op in "MDN"), y + n * (op in "MIS")
    out = {}
    for pos, kinds in gaps.items():
        kinds = sorted(kinds | {0})
        left, right = max(0, pos - window), min(len(ref), pos + window - min(0, kinds[0]))
        insert = {}
        for t in kinds:
            if t > 0:
                letters = [collections.Counter(s[i] for s in texts[pos, t] if s[i] in "ACGT") for i in range(t)]
                insert[t] = "".join(max("ACGT", key=lambda c: (n[c], -ord(c))) if n else "N" for n in letters)
        lost = {}
        for t in kinds:
            longest = -min(0, kinds[0])
            hap = ref[left : pos + 1] + insert.get(t, "") + "N" * (min(longest, right - pos - 1) + min(t, 0)) + ref[pos + 1 + longest : right]
            for k, _ in covered[pos]:
                at, cigar, seq, qualities, _ = reads[k]
                # the read's places and the reference's that lie in the window
                x, y, q0, t0, q1, t1 = at, 0, None, None, None, None
                last = 0
                for n, op in operations(cigar):
                    if op in "MDN":
                        if q0 is None and x + n > left:
                            q0, t0 = (y, at) if at > left else (y + left - x, left) if op == "M" else (y, x + n)
                        if q1 is None and x + n > right:
                            q1, t1 = (y + right - x, right) if op == "M" else (y, x)
                    x, y = x + n * (op in "MDN"), y + n * (op in "MIS")
                    last = y if op == "M" else last
                if q1 is None:
                    q1, t1 = last, x
                a, b = codes(hap[t0 - left : max(0, t1 + t - left)]), codes(seq[q0:q1])
                if t1 - t0 + t <= 0:
                    lost[t, k] = 1 << 20
                    continue
                ops = operations(global_align(a, b, 2 * max(0, kinds[-1]) + 2, scores)[1])
                i = j = sum_ = 0
                for z, (n, op) in enumerate(ops):
                    if op == "M":
                        sum_ += sum(min(30, qualities[q0 + j + d]) for d in range(n) if a[i + d] != b[j + d] and a[i + d] < 4)
                    elif 0 < z < len(ops) - 1:
                        sum_ += 40 * n
                    i, j = i + n * (op != "I"), j + n * (op != "D")
                lost[t, k] = sum_
        order = sorted(range(len(kinds)), key=lambda i: (sum(lost[kinds[i], k] for k, _ in covered[pos]), i))[:2]
        one, two = (kinds[i] for i in order)
        most = int(40 * (1 - 0.9 ** (abs(order[0] - order[1]) + 1)) / (1 - 0.9))
        differ = [lost[one, k] - lost[two, k] for k, _ in covered[pos]]
        depth, prior = len(differ), int(-4.343 * math.log(0.00015) + 0.5)
        q = [sum(min(most, d) for d in differ if d > 0), sum(min(most, -d) for d in differ if d <= 0), depth * 3 + prior]
        show = lambda t: "+" + insert[t] if t > 0 else "-" + ref[pos + 1 : pos + 1 - t].upper() if t else "*"
        g = q.index(min(q))
        own = [show(one), show(two)]
        cons = f"{own[g]}/{own[g]}" if g < 2 else f"{own[0]}/{own[1]}"
        lead = (0 if own[g] == "*" else q[1 - g] - q[g] - prior - 3) if g < 2 else (q[0] if own[0] == "*" else q[1]) - q[2]
        squares = sum(min(60, reads[k][4]) ** 2 for k, _ in covered[pos])
        seen = [s for _, s in covered[pos]]
        out[pos] = (cons, sorted(q)[1] - min(q), max(0, lead), int(math.sqrt(squares / depth) + 0.499), depth, *own, seen.count(one), seen.count(two))
    return out
