"""Addresses, places, and what numbers tell of a place; dictionaries are parameters.

A gazetteer is a table (province, city, county, [town, village,] aliases). It is
bounded by the map, not by the data, and its size is checked before it is sent
to the workers.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphline.shared import once

MAX_ROWS = 1_000_000
PARSED = "province string, city string, county string, town string, village string, detail string, full_location string, orig_location string"


def lookup(df: DataFrame, key: Column, table: DataFrame, cols: list[str], lengths: list[int], code: str = "code") -> DataFrame:
    """``df`` with ``cols`` of the row of ``table`` whose code is the longest prefix of ``key``, of ``lengths``.

    One left equi-join for each length; Spark broadcasts the table if it is small.
    """
    out, found = df.withColumn("_key", key), {c: [] for c in cols}
    for n in sorted(lengths, reverse=True):
        t = table.where(F.length(code) == n).dropDuplicates([code]).select(F.col(code).alias(f"_c{n}"), *[F.col(c).alias(f"_{c}{n}") for c in cols])
        out = out.join(t, F.substring("_key", 1, n) == t[f"_c{n}"], "left")
        for c in cols:
            found[c].append(F.when(F.col(f"_c{n}").isNotNull(), F.struct(F.col(f"_{c}{n}").alias("v"))))
    keep = [F.col(f"`{c}`") for c in df.columns if c not in cols]
    return out.select(*keep, *[F.coalesce(*found[c])["v"].alias(c) for c in cols])


class Gazetteer:
    """Names to places: exact and in running text."""

    def __init__(self, rows: list[dict], changes: dict[tuple, tuple] | None = None):
        import ahocorasick

        self.changes = changes or {}
        names: dict[str, list[tuple[int, int, tuple]]] = {}
        for r in rows:
            path = tuple(r.get(k) for k in ("province", "city", "county", "town", "village"))
            level = max((i for i, x in enumerate(path) if x), default=-1)
            if level < 0:
                continue
            for full, name in [(1, path[level]), *[(0, a) for a in r.get("aliases") or []]]:
                if name and (full, level, path) not in names.setdefault(name, []):
                    names[name].append((full, level, path))
        self.names = names
        self.made = ahocorasick.Automaton()
        for n in names:
            self.made.add_word(n, n)
        if names:
            self.made.make_automaton()

    def candidates(self, text: str) -> list[tuple[int, str, int, int, tuple]]:
        if not self.names:
            return []
        out = []
        for end, name in self.made.iter(text):
            start = end - len(name) + 1
            follows = text[end + 1 : end + 3]
            for full, level, path in self.names[name]:
                # a short name before a word for a street is no place
                if not full and (follows[:1] in ("路", "街") or follows == "大街"):
                    continue
                out.append((start, name, full, level, path))
        return out

    def parse(self, text: str, town_village: bool = False, renew: bool = True) -> dict:
        """The path that most names of the text agree on, early and full names first; what follows its last name is the detail."""
        hits = [h for h in self.candidates(text) if h[3] <= 2]
        best = None
        for path in {h[4] for h in hits}:
            used: dict[int, tuple] = {}
            for start, name, full, level, p in sorted(hits, key=lambda h: (h[0], -len(h[1]))):
                if p[: level + 1] == path[: level + 1] and (level not in used or (full, -start) > (used[level][2], -used[level][0])):
                    used[level] = (start, name, full)
            spans, ok = sorted((s, s + len(n), lv) for lv, (s, n, _) in used.items()), {}
            for s, e, lv in sorted(spans, key=lambda x: (x[0] - x[1], x)):
                if all(s >= e2 or e <= s2 for s2, e2 in ok.values()):
                    ok[lv] = (s, e)
            ordered = [ok[lv][0] for lv in sorted(ok)]
            if ordered != sorted(ordered):
                continue
            fulls = sum(used[lv][2] for lv in ok)
            depth = max((i for i, x in enumerate(path) if x), default=0)
            rank = (len(ok), -sum(ordered), fulls, sum(e - s for s, e in ok.values()), -depth, path[0] or "")
            if best is None or rank > best[0]:
                best = (rank, path, ok)
        place: list[str | None] = [None] * 5
        cut = 0
        if best:
            deepest = max(best[2])
            place[: deepest + 1] = best[1][: deepest + 1]
            cut = max(e for _, e in best[2].values())
        detail = text[cut:] if best else text
        if renew and tuple(place[:3]) in self.changes:
            place[:3] = self.changes[tuple(place[:3])]
        if town_village and best:
            inner = [h for h in self.candidates(text) if h[3] >= 3 and h[4][:3] == tuple(best[1][:3])]
            for level in (3, 4):
                own = sorted(h[0:2] + (h[4],) for h in inner if h[3] == level and (level == 3 or place[3] is None or h[4][3] == place[3]))
                if own:
                    place[3 : level + 1] = own[0][2][3 : level + 1]
        province, city, county = place[:3]
        if city is None and province and province.endswith("市"):
            city = province
        shown = [x for x in dict.fromkeys([province, city, county]) if x]
        return {"province": province, "city": city, "county": county, "town": place[3], "village": place[4], "detail": detail, "full_location": "".join(shown) + detail, "orig_location": text}

    def exact(self, name: str) -> list[tuple]:
        """Paths down to the county that a name stands for, full names first."""
        known = self.names.get(name, [])
        full = [p[:3] for f, lv, p in known if f and lv <= 2]
        return list(dict.fromkeys(full or [p[:3] for _, lv, p in known if lv <= 2]))

    def recognise(self, counts: list[tuple[str, int]], top: int = 3) -> list[tuple[tuple, int]]:
        """Places of counted names: a name of several places goes to the one that others agree with; the most specific stay."""
        merged: dict[tuple, int] = {}
        for name, n in sorted(counts, key=lambda x: (-x[1], x[0])):
            paths = self.exact(name)
            if not paths:
                continue
            agree = lambda p: max((sum(a == b for a, b in zip(p, q, strict=True) if a) for q in merged), default=0)
            path = max(paths, key=lambda p: (agree(p), -paths.index(p)))
            for q in list(merged):
                known = [x for x in q if x]
                mine = [x for x in path if x]
                if known == mine[: len(known)] or mine == known[: len(mine)]:
                    n += merged.pop(q)
                    path = max((path, q), key=lambda p: sum(x is not None for x in p))
            merged[path] = merged.get(path, 0) + n
        return sorted(merged.items(), key=lambda x: (-x[1], repr(x[0])))[:top]


def collected(gazetteer: DataFrame) -> list[dict]:
    rows = gazetteer.limit(MAX_ROWS + 1).collect()
    if len(rows) > MAX_ROWS:
        raise ValueError(f"gazetteer of more than {MAX_ROWS} rows")
    return [r.asDict(recursive=True) for r in rows]


def parse_locations(df: DataFrame, text_col: str, gazetteer: DataFrame, changes: dict[tuple, tuple] | None = None, town_village: bool = False) -> DataFrame:
    """``df`` with the parts of an address (columns of these names are replaced)."""
    shared = df.sparkSession.sparkContext.broadcast((collected(gazetteer), changes))
    key = f"gazetteer {uuid.uuid4().hex}"
    names = [x.split()[0] for x in PARSED.split(", ")]
    kept = df.select(*[F.col(f"`{c}`") for c in df.columns if c not in names])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        places = once(key, lambda: Gazetteer(*shared.value))
        blank = dict.fromkeys(names)
        for f in frames:
            parsed = pd.DataFrame([blank if t is None else places.parse(t, town_village) for t in f[text_col]], columns=names, index=f.index)
            yield pd.concat([f, parsed], axis=1)

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    return kept.mapInPandas(run, f"{ddl}, {PARSED}")


class WorldPlaces:
    """Names to (country, city); cities are also known with 市 behind them."""

    def __init__(self, rows: list[dict]):
        self.names: dict[str, list[tuple[str, str | None]]] = {}
        for r in rows:
            for name, place in [(n, (r["country"], None)) for n in (r["country"], *(r.get("aliases") or []))] + ([(n, (r["country"], r["city"])) for n in (r["city"], f"{r['city']}市")] if r.get("city") else []):
                if place not in self.names.setdefault(name, []):
                    self.names[name].append(place)

    def recognise(self, counts: list[tuple[str, int]], top: int = 3) -> list[tuple[tuple, int]]:
        """Places of counted names; a country is folded into its most frequent city that is named too."""
        cities: dict[tuple, int] = {}
        countries: dict[str, int] = {}
        for name, n in counts:
            for country, city in self.names.get(name, []):
                if city:
                    cities[country, city] = cities.get((country, city), 0) + n
                else:
                    countries[country] = countries.get(country, 0) + n
        for country, n in countries.items():
            own = [p for p in cities if p[0] == country]
            place = max(own, key=lambda p: (cities[p], p)) if own else (country, None)
            cities[place] = cities.get(place, 0) + n
        return sorted(cities.items(), key=lambda x: (-x[1], repr(x[0])))[:top]


def recognise_locations(df: DataFrame, id_col: str, tokens: str, gazetteer: DataFrame, top: int = 3, world: DataFrame | None = None) -> DataFrame:
    """id, kind, rank, province, city, county, country, name, n: the places that a text's place tokens (pos ns) name most.

    Kinds: domestic (of ``gazetteer``), foreign (of ``world``: country, city, aliases) and other, the names of
    neither, which aren't cut to ``top``. Tokens are counted by document in the array itself; nothing is shuffled.
    """
    shared = df.sparkSession.sparkContext.broadcast((collected(gazetteer), collected(world) if world is not None else []))
    key = f"places {uuid.uuid4().hex}"
    words = F.transform(F.filter(tokens, lambda t: t["pos"] == "ns"), lambda t: t["word"])
    columns = ["id", "kind", "rank", "province", "city", "county", "country", "name", "n"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        places, abroad = once(key, lambda: (Gazetteer(shared.value[0]), WorldPlaces(shared.value[1])))
        for f in frames:
            rows: list[tuple] = []
            for doc, ws in zip(f["id"], f["words"], strict=True):
                counts: dict[str, int] = {}
                for w in [] if ws is None else ws:
                    counts[w] = counts.get(w, 0) + 1
                known = list(counts.items())
                rows += [(doc, "domestic", k + 1, *path, None, None, n) for k, (path, n) in enumerate(places.recognise(known, top))]
                rows += [(doc, "foreign", k + 1, None, city, None, country, None, n) for k, ((country, city), n) in enumerate(abroad.recognise(known, top))]
                rest = sorted(((w, n) for w, n in known if not places.exact(w) and w not in abroad.names), key=lambda x: (-x[1], x[0]))
                rows += [(doc, "other", k + 1, None, None, None, None, w, n) for k, (w, n) in enumerate(rest)]
            yield pd.DataFrame(rows, columns=columns, dtype=object)

    kinds = "id string, kind string, rank int, province string, city string, county string, country string, name string, n long"
    return df.select(F.col(id_col).cast("string").alias("id"), words.alias("words")).mapInPandas(run, kinds)
