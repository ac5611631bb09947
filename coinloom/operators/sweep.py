"""Transfers of one strip of amounts: outflows in order each take the free inflow they like best.

A strip holds all rows of some owners, or those of one owner between two amounts. Rows lie in
queues by owner, day, amount, wording and account, so no pairs are listed. What rows beyond the
strip's ends may do is not known here: an inflow that one of them may take is doubtful, and an
outflow that likes a doubtful inflow best, or one beyond, is left open and makes doubtful what it
may take in its place. All others get what a pass over every row would give them.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Amounts are held as whole numbers of the tenth decimal place; so many are 1.00.
ONE = 10**10
#: Similarities that are remembered at once.
REMEMBERED = 500_000


def units(amounts: pa.Array) -> list[int]:
    """Unscaled values of a column of decimal(38, 10) without nulls."""
    halves = np.frombuffer(amounts.buffers()[1], dtype="<i8").reshape(-1, 2)[amounts.offset : amounts.offset + len(amounts)]
    low, high = halves[:, 0], halves[:, 1]
    if (high == low >> 63).all():
        return low.tolist()
    return [(h << 64) + (x & ((1 << 64) - 1)) for x, h in zip(low.tolist(), high.tolist(), strict=True)]


def wordings(words: list[str], codes: list[int], out: list[bool]) -> tuple[list[int], list[tuple[frozenset, int]]]:
    """(class of each wording, classes): words that both sides use, and how many words there are.

    A word that only outflows or only inflows use is shared by no pair; its number is all that counts.
    """
    cut = [frozenset(w.split(" ")) if w else frozenset() for w in words]
    used: tuple[set, set] = (set(), set())
    for code, side in set(zip(codes, out, strict=True)):
        used[side].update(cut[code])
    both = used[0] & used[1]
    classes: dict[tuple[frozenset, int], int] = {}
    of = [classes.setdefault((w & both, len(w)), len(classes)) for w in cut]
    return of, list(classes)


class _Likeness:
    """Shared words over all words of two classes of wordings."""

    def __init__(self, classes: list[tuple[frozenset, int]]):
        self.classes, self.known = classes, {}

    def __call__(self, a: int, b: int) -> float:
        got = self.known.get((a, b))
        if got is None:
            (one, n), (two, m) = self.classes[a], self.classes[b]
            both = len(one & two)
            got = both / (n + m - both) if n and m else 0.0
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[a, b] = got
        return got


class _Free:
    """Inflows that may be taken: by day and amount, by class of wording, by account."""

    def __init__(self, rows: list[int], day: list[int], amount: list[int], kind: list[int], account: list[int], like: _Likeness):
        self.kind, self.account, self.like = kind, account, like
        self.days: dict[int, tuple] = {}
        lists: dict[int, dict[int, list[int]]] = {}
        for r in rows:
            lists.setdefault(day[r], {}).setdefault(amount[r], []).append(r)
        for d, by_amount in lists.items():
            at = sorted(by_amount)
            # Where to look next, on the right and on the left, from a place whose rows are all taken.
            self.days[d] = (at, [self._bucket(by_amount[a]) for a in at], list(range(len(at) + 1)), list(range(len(at) + 1)))

    def _bucket(self, rows: list[int]):
        """One row itself; of several, by class a heap of each account's first and the further rows of accounts, last first."""
        if len(rows) == 1:
            return rows[0]
        out: dict[int, tuple[list[int], dict[int, list[int]]]] = {}
        seen = set()
        for r in rows:
            firsts, more = out.setdefault(self.kind[r], ([], {}))
            mark = (self.kind[r], self.account[r])
            if mark in seen:
                more.setdefault(self.account[r], []).append(r)
            else:
                seen.add(mark)
                firsts.append(r)
        for _, more in out.values():
            for own in more.values():
                own.reverse()
        return out

    @staticmethod
    def _next(links: list[int], k: int) -> int:
        """The place that a place's links lead to; ways are shortened as they are gone."""
        root = k
        while links[root] != root:
            root = links[root]
        while links[k] != root:
            links[k], k = root, links[k]
        return root

    def first(self, days: tuple[int, ...], amount: int, kind: int, account: int) -> tuple | None:
        """(difference, less likeness, row, day, place) of the best row on the days, of another account."""
        ways = []
        for d in days:
            known = self.days.get(d)
            if known is not None:
                at, _, right, left = known
                p = bisect_left(at, amount)
                k = self._next(right, p)
                if k < len(at) and at[k] - amount <= ONE:
                    ways.append([at[k] - amount, d, k, True])
                # Places of the way left are one higher, so that 0 is its end.
                k = self._next(left, p)
                if k and amount - at[k - 1] <= ONE:
                    ways.append([amount - at[k - 1], d, k - 1, False])
        while ways:
            least = min(w[0] for w in ways)
            best = None
            for w in ways:
                if w[0] == least:
                    best = self._look(w[1], w[2], least, kind, account, best)
            if best is not None:
                return best
            on = []
            for w in ways:
                if w[0] == least:
                    at, _, right, left = self.days[w[1]]
                    if w[3]:
                        w[2] = self._next(right, w[2] + 1)
                        if w[2] == len(at) or at[w[2]] - amount > ONE:
                            continue
                        w[0] = at[w[2]] - amount
                    else:
                        k = self._next(left, w[2])
                        if not k or amount - at[k - 1] > ONE:
                            continue
                        w[2], w[0] = k - 1, amount - at[k - 1]
                on.append(w)
            ways = on
        return None

    def _look(self, day: int, place: int, difference: int, kind: int, account: int, best: tuple | None) -> tuple | None:
        bucket = self.days[day][1][place]
        if type(bucket) is int:
            if self.account[bucket] != account:
                found = (difference, -self.like(kind, self.kind[bucket]), bucket, day, place)
                return found if best is None or found < best else best
            return best
        for other, (firsts, _) in bucket.items():
            r = firsts[0]
            if self.account[r] == account:
                r = min(firsts[1:3], default=None)
            if r is not None:
                found = (difference, -self.like(kind, other), r, day, place)
                if best is None or found < best:
                    best = found
        return best

    def remove(self, r: int, day: int, place: int) -> None:
        _, buckets, right, left = self.days[day]
        bucket = buckets[place]
        if type(bucket) is not int:
            firsts, more = bucket[self.kind[r]]
            top = heapq.heappop(firsts)
            if top != r:  # the first row is of the claimant's own account, and the second was taken
                heapq.heappop(firsts)
                heapq.heappush(firsts, top)
            further = more.get(self.account[r])
            if further:
                heapq.heappush(firsts, further.pop())
            if not firsts:
                del bucket[self.kind[r]]
            if bucket:
                return
        buckets[place] = {}
        right[place], left[place + 1] = place + 1, place


class _Doubtful:
    """Inflows that may have been taken: of each day, amount and class the first, and the first of another account."""

    def __init__(self, kind: list[int], account: list[int], like: _Likeness):
        self.kind, self.account, self.like = kind, account, like
        self.days: dict[int, tuple[list[int], dict[int, dict[int, list[int]]]]] = {}

    def add(self, r: int, day: int, amount: int) -> None:
        at, buckets = self.days.setdefault(day, ([], {}))
        if amount not in buckets:
            insort(at, amount)
        own = buckets.setdefault(amount, {}).setdefault(self.kind[r], [])
        ranked = sorted([*own, r])
        own[:] = [ranked[0], *[x for x in ranked if self.account[x] != self.account[ranked[0]]][:1]]

    def before(self, days: tuple[int, ...], amount: int, kind: int, account: int, than: tuple | None) -> bool:
        """Whether a row on the days is liked better than what was found, or anything is if nothing was."""
        reach = ONE if than is None else than[0]
        for d in days:
            known = self.days.get(d)
            if known is None:
                continue
            at, buckets = known
            k = bisect_left(at, amount - reach)
            while k < len(at) and at[k] <= amount + reach:
                for other, rows in buckets[at[k]].items():
                    r = next((x for x in rows if self.account[x] != account), None)
                    if r is not None and (than is None or (abs(at[k] - amount), -self.like(kind, other), r) < than[:3]):
                        return True
                k += 1
        return False


def settle(strip: pa.Table) -> tuple[list[tuple[int, int, int, int, float]], list[int]]:
    """(matches, rows left open) of a strip in order of id: outflow, inflow, days, difference and likeness of each match.

    strip: scope, account_id, words (strings), date, amount (decimal(38, 10)), out, edge (whether a
    row beyond the strip's ends may be a partner). Left open are outflows, and the inflows that they or
    rows beyond may take.
    """
    if not strip.num_rows:
        return [], []
    coded = [strip[c].combine_chunks().dictionary_encode() for c in ("scope", "account_id", "words")]
    scope, account, wording = (c.indices.to_pylist() for c in coded)
    out, edge = strip["out"].to_pylist(), strip["edge"].to_pylist()
    on = np.asarray(strip["date"].cast(pa.int32())).astype("int64")
    # Days of different scopes lie far apart.
    day = [(s << 24) + d + (1 << 22) for s, d in zip(scope, on.tolist(), strict=True)]
    amount = units(strip["amount"].combine_chunks())
    of, classes = wordings(coded[2].dictionary.to_pylist(), wording, out)
    kind, like = [of[w] for w in wording], _Likeness(classes)

    free = _Free([r for r, o in enumerate(out) if not o and not edge[r]], day, amount, kind, account, like)
    doubtful = _Doubtful(kind, account, like)
    left = [r for r, o in enumerate(out) if not o and edge[r]]
    for r in left:
        doubtful.add(r, day[r], amount[r])
    matches = []
    claimants = np.flatnonzero(out)
    for r in claimants[np.argsort(on[claimants], kind="stable")].tolist():
        d, unsure, got, days = day[r], edge[r], None, 0
        for days, near in enumerate(((d,), (d - 1, d + 1))):
            got = free.first(near, amount[r], kind[r], account[r])
            unsure = unsure or doubtful.before(near, amount[r], kind[r], account[r], got)
            if got is not None:
                break
        if got is not None:
            free.remove(got[2], got[3], got[4])
        if unsure:
            left.append(r)
            if got is not None:
                doubtful.add(got[2], day[got[2]], amount[got[2]])
                left.append(got[2])
        elif got is not None:
            matches.append((r, got[2], days, got[0], -got[1]))
    return matches, left


def swept(strip: pa.Table) -> pa.Table:
    """A strip's matches, with inflow_id and what is known of them, and the rows that it leaves open, without."""
    strip = strip.take(pc.sort_indices(strip["id"])) if strip.num_rows else strip
    matches, left = settle(strip)
    outs, ins = (pa.array([m[k] for m in matches], pa.int64()) for k in (0, 1))
    known = {
        "id": strip["id"].take(outs),
        "inflow_id": strip["id"].take(ins),
        "is_credit_card": pc.or_(strip["is_credit_card"].take(outs), strip["is_credit_card"].take(ins)),
        "days": pa.array([m[2] for m in matches], pa.int32()),
        "difference": pa.array([m[3] for m in matches], pa.int64()),
        "similarity": pa.array([m[4] for m in matches], pa.float64()),
    }
    rest = strip.take(pa.array(left, pa.int64())).drop_columns(["strip", "edge"])
    empty = rest.slice(0, 0)
    found = pa.table({**{c: known.get(c, pa.nulls(len(matches), empty[c].type)) for c in rest.column_names}, **{c: v for c, v in known.items() if c not in rest.column_names}})
    for c in known:
        if c not in rest.column_names:
            rest = rest.append_column(c, pa.nulls(rest.num_rows, found[c].type))
    return pa.concat_tables([found, rest])
