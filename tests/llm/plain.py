"""Plain versions of the operators, for small fixtures."""

import hashlib
import math
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall(text or "")


def shingles(text, k):
    w = words((text or "").translate(LOWER))
    return frozenset([tuple(w)] if 0 < len(w) < k else (tuple(w[i : i + k]) for i in range(len(w) - k + 1)))


def components(rows, k, percent=80):
    """{position: smallest position reachable} of (doc_id, text) rows."""
    sets = [shingles(t, k) for _, t in rows]
    group = list(range(len(rows)))

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                group[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(rows))]


FURNITURE = (
    "cookie cookies subscribe copyright impressum anmelden abonnieren abonnez-vous suscríbase datenschutzerklärung nutzungsbedingungen".split()
    + ["privacy policy", "terms of use", "terms of service", "all rights reserved", "licensed under", "enable javascript", "lorem ipsum",
       "click here", "sign up", "log in", "powered by", "politique de confidentialité", "mentions légales", "conditions d'utilisation",
       "tous droits réservés", "cliquez ici", "se connecter", "alle rechte vorbehalten", "hier klicken", "política de privacidad", "aviso legal",
       "términos de uso", "todos los derechos reservados", "haga clic aquí", "iniciar sesión"])


def phrases(line):
    """How many phrases of page furniture stand in a line, each behind the one before, with a sign in between of its own."""
    low, n, at = line.translate(LOWER), 0, 0
    while at <= len(low):
        for phrase in sorted(FURNITURE, key=len, reverse=True):
            for lead in (0, 1):
                start = at + lead
                if (lead == 0 and at != 0) or (lead and (at >= len(low) or low[at].isalnum())) or not low.startswith(phrase, start):
                    continue
                end = start + len(phrase)
                if end < len(low) and low[end].isalnum():
                    continue
                break
            else:
                continue
            n, at = n + 1, end + 1
            break
        else:
            at += 1
    return n


def quality(text):
    """(figures..., base_failed, kept, cleaned)"""
    w = words(text)
    windows, covered = {}, set()
    for i in range(len(w) - 2):
        windows.setdefault(tuple(w[i : i + 3]), []).append(i)
    for at in windows.values():
        if len(at) > 1:
            for i in at:
                covered |= {i, i + 1, i + 2}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    once = list(dict.fromkeys(lines))
    good = []
    for x in once:
        n = len(words(x))
        marks = len(re.findall(r"[#*$%&|<>]", x)) > n * 0.2 or len(re.findall("!!", x)) > n * 0.2
        stops = n >= 30 and not re.search(r"[.!?:;…。！？][\"'”’»)\]]*([\x20\x09-\x0D]|$)", x)
        navigation = len(re.findall(r"[|»›•·→]", x)) * 4 > n
        if not (marks or stops or navigation or 0 < phrases(x) * 8 >= n):
            good.append(x)
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    lost = len("".join(lines)) - len("".join(good))
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(once), len(covered), failed,
            not failed and lost <= len("".join(lines)) * 0.5, "\n".join(good))


def targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    """{source: target} by sharing again what is over, until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, free, out = share * sum(sizes.values()), set(order), {}
    while free:
        total = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / total >= most * sizes[s]}
        if not over:
            out.update({s: left * weight[s] / total for s in free})
            break
        for s in over:
            out[s] = most * sizes[s]
            left -= out[s]
        free -= over
    return out


def probabilities(sizes, missing):
    """Inclusion of documents in proportion to size, certain ones first, so that ``missing`` words are included on average."""
    out, left = [0.0] * len(sizes), missing
    open_ = [i for i, n in enumerate(sizes) if n > 0] if missing > 0 else []
    while open_:
        most = max(sizes[i] for i in open_)
        squares = sum(sizes[i] ** 2 for i in open_)
        if left * most < squares:
            for i in open_:
                out[i] = left / squares * sizes[i]
            break
        for i in [i for i in open_ if sizes[i] == most]:
            out[i] = 1.0
            left -= sizes[i]
        open_ = [i for i in open_ if sizes[i] < most]
    return out


def mix(rows, seed="mix"):
    """Copies of each (doc_id, text, source) row; of equal rows any may be the ones that are drawn."""
    size = [len(words(t)) for _, t, _ in rows]
    sums = {}
    for (_, _, s), n in zip(rows, size, strict=True):
        sums[s] = sums.get(s, 0) + n
    goal, copies = targets(sums), [0] * len(rows)
    for s, total in sums.items():
        sure = math.floor(goal[s] / total) if total else 0
        left = goal[s] - sure * total
        own = [i for i, r in enumerate(rows) if r[2] == s]
        seen, ranked = {}, []
        for i, p in zip(own, probabilities([size[i] for i in own], left), strict=True):
            copies[i] = sure
            key = hashlib.md5(f"{'' if rows[i][0] is None else rows[i][0]}:{rows[i][1] or ''}".encode()).hexdigest()
            n = seen[key] = seen.get(key, -1) + 1
            u = int(hashlib.md5(f"{seed}:{key}:{n}".encode()).hexdigest()[:13], 16) / 2**52
            if p > 0:
                ranked.append((u * (1 - p) / (u * (1 - p) + (1 - u) * p), key, n, i))
        run = 0
        for *_, i in sorted(ranked):
            if run + size[i] <= left or (run < left and run + size[i] - left < left - run):
                copies[i] += 1
            run += size[i]
    return copies


def viterbi(word, pieces, unknown):
    """[(start, end, id or None)] of the best path, ties to the longer last piece."""
    best = [(0.0, 0, None)]
    for end in range(1, len(word) + 1):
        ways = [(best[s][0] + pieces[word[s:end]][1], -s, pieces[word[s:end]][0]) for s in range(max(0, end - 16), end) if word[s:end] in pieces]
        if word[end - 1] not in pieces:
            ways.append((best[end - 1][0] + unknown, -(end - 1), None))
        best.append(max(ways, key=lambda x: x[:2]))
    path, end = [], len(word)
    while end:
        path.append((-best[end][1], end, best[end][2]))
        end = -best[end][1]
    return path[::-1]


def encode(text, model):
    if not text:
        return []
    pieces = {p: (i, s) for p, i, s in model.rows}
    word = "▁" + text.replace(" ", "▁")
    out = []
    for a, b, i in viterbi(word, pieces, model.unknown_score):
        out += [i] if i is not None else [model.bytes_from + x for x in word[a:b].encode()]
    return out
