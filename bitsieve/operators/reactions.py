"""Molecule hits lifted to reactions, and reactions searched by all their components in one plan."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bitsieve.functions.graph_columns import reaction_key

#: Queries of a block in ``top_each``, least and most, their component hits at most; reactions of a block, least and most; results for which blocks have the least queries and the most reactions; reactions and queries that are scored at a time.
QUERIES, HITS, REACTIONS, LISTED, SLICE, TOGETHER = (4096, 1 << 16), 1 << 21, (1 << 18, 1 << 21), 1000, 32768, 128
#: Reactions of a block (by centre: of one whose results are in order), and queries that meet it at most, in ``ranked_in_blocks``; stored sets that are indexed at a time; asked sets whose hits a worker keeps; rows that leave it at a time; times that a molecule is written at once. Stored sets of a block in ``similar_in_blocks``.
BLOCK, CENTRED, ASKED, SETS, KEPT, ROWS, TIMES, STORED = 1 << 18, 1 << 21, 1 << 15, 1 << 14, 64, 1 << 15, 6, 1 << 17


def in_role(roles: DataFrame, is_product: bool | None) -> DataFrame:
    """All rows, or those of one role; rows without a role are in neither."""
    return roles if is_product is None else roles.where(F.col("is_product") == is_product)


def lifted(hits: DataFrame, substances: DataFrame, roles: DataFrame, is_product: bool | None, *, component: str = "molecule") -> DataFrame:
    """``hits`` (by molecule or non-organic) with every ``reaction, is_product`` that uses it: a bag."""
    used = substances.where(F.col(component).isNotNull()).select("substance", component)
    return hits.join(used, component).join(in_role(roles, is_product), "substance").drop("substance")


def components(reactions: DataFrame, substances: DataFrame, roles: DataFrame) -> DataFrame:
    """``query, component_no, is_product, molecule, non_organic`` of the given reactions (``query``), each component once."""
    own = reactions.join(roles.where("is_product is not null").withColumnRenamed("reaction", "query"), "query").join(substances, "substance")
    own = own.select("query", "is_product", "molecule", "non_organic").distinct()
    return own.withColumn("component_no", F.xxhash64("is_product", "molecule", "non_organic"))


def holding_all(query_components: DataFrame, store_components: DataFrame, *, fix_roles: bool = True) -> DataFrame:
    """``query, reaction``: reactions that hold every component of a query, in its role if ``fix_roles``.

    Extra components are allowed and multiplicity doesn't count. ``store_components`` has ``reaction, is_product,
    component``; ``query_components`` ``query, is_product, component``. Pairs are met through the query's rarest
    component only; intersection is one count per pair.
    """
    on = ["component", "is_product"] if fix_roles else ["component"]
    q = query_components.select("query", *on).distinct()
    store = store_components.select("reaction", *on).distinct()
    need = q.groupBy("query").agg(F.count(F.lit(1)).alias("need"))
    df = store.groupBy(*on).agg(F.count(F.lit(1)).alias("df"))
    first = Window.partitionBy("query").orderBy(F.coalesce("df", F.lit(0)), *on)
    rarest = q.join(df, on, "left").withColumn("at", F.row_number().over(first)).where("at = 1").select("query", *on)
    pairs = rarest.join(store, on).select("query", "reaction")
    met = pairs.join(q, "query").join(store, ["reaction", *on]).groupBy("query", "reaction").agg(F.count(F.lit(1)).alias("met"))
    return met.join(need, "query").where("met = need").select("query", "reaction")


def ranked(hits: DataFrame, *, ordered: bool = True) -> DataFrame:
    """``query, reaction, molecules, score`` of component hits ``query, component_no, reaction, molecule, t``.

    Ordered: the score is the sum over all (component, molecule) matches, added up in billionths so that the
    order of addition doesn't matter; one matching component suffices.
    Unordered: distinct molecules, the score is their number.
    """
    if ordered:
        one = hits.select("query", "component_no", "reaction", "molecule", "t").distinct()
        return one.groupBy("query", "reaction").agg(
            F.array_join(F.array_sort(F.collect_list("molecule")).cast("array<string>"), ",").alias("molecules"), (F.sum(F.round(F.col("t") * 1e9).cast("long")) / F.lit(1e9)).alias("score")
        )
    one = hits.select("query", "reaction", "molecule").distinct()
    return one.groupBy("query", "reaction").agg(
        F.array_join(F.array_sort(F.collect_list("molecule")).cast("array<string>"), ",").alias("molecules"), F.count(F.lit(1)).cast("double").alias("score")
    )


def top_each(hits: DataFrame, used: DataFrame, k: int, *, counted: DataFrame | None = None) -> DataFrame:
    """``query, reaction, score``: the k best reactions of each query by the score of :func:`ranked`, ties to the least reaction.

    ``hits`` has ``query, component_no, is_product, molecule, t``, ``used`` ``reaction, is_product, molecule``. A block of queries goes through a block of reactions in the order
    of their ids, some thousand at a time, and keeps its k best; only what beats the k-th so far is looked at. Pairs of a query and a reaction are never rows.
    Reactions are sent once for each block of queries, k results of a query for each block of reactions: the fewer results, the more queries and the fewer reactions a block has.
    Blocks are sized by an estimate of how many reactions ``counted`` (``used``, unless another table is given) has.
    """
    key = (F.col("molecule") * 2 + F.col("is_product").cast("long")).alias("key")
    weights = hits.where("is_product is not null").select("query", "component_no", key, "t").distinct().groupBy("query", "key").agg(F.sum(F.round(F.col("t") * 1e9).cast("long")).alias("w"))
    weights = weights.groupBy("query").agg(F.collect_list("key").alias("keys"), F.collect_list("w").alias("ws"))
    held = used.where("is_product is not null").groupBy("reaction").agg(F.collect_set(key).alias("keys"))
    asked, stored = min(QUERIES[1], max(QUERIES[0], QUERIES[0] * LISTED // k)), max(REACTIONS[0], min(REACTIONS[1], REACTIONS[1] * k // LISTED))
    blocks = lambda df, name, n, *more: df.agg(F.greatest(F.ceil(F.approx_count_distinct(name, 0.02) / n), *more, F.lit(1)).cast("int").alias(f"__{name[0]}"))
    parts = F.broadcast(blocks(used if counted is None else counted, "reaction", stored).crossJoin(F.broadcast(blocks(hits, "query", asked, F.ceil(F.count(F.lit(1)) / HITS)))))
    own = lambda name, n: F.pmod(F.xxhash64(name), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = weights.crossJoin(parts).select("query", "keys", "ws", own("query", "__q").alias("__qb"), every("__r").alias("__rb"))
    right = held.crossJoin(parts).select("reaction", "keys", own("reaction", "__r").alias("__rb"), every("__q").alias("__qb"))
    flat = lambda column: pc.list_flatten(column.combine_chunks()).to_numpy(zero_copy_only=False).astype(np.int64)
    lengths = lambda column: pc.list_value_length(column.combine_chunks()).to_numpy(zero_copy_only=False).astype(np.int64)

    def best(q: pa.Table, r: pa.Table) -> pa.Table:
        asked, keys, ws = np.repeat(np.arange(q.num_rows), lengths(q["keys"])), flat(q["keys"]), flat(q["ws"]).astype(np.float64)
        ends = np.r_[0, np.cumsum(lengths(q["keys"]))].astype(np.int64)
        names, code = np.unique(keys, return_inverse=True)
        order = np.argsort(r["reaction"].to_numpy(), kind="stable")
        r = r.select(["reaction", "keys"]).take(pa.array(order))
        top = [[np.zeros(0, np.int64)] * 3 for _ in range(-(-q.num_rows // TOGETHER))]  # of each chunk of queries: query, score, place of the reaction
        least = np.zeros(q.num_rows)
        at, wide = 0, 1024
        while at < r.num_rows and len(names):
            part = r.slice(at, wide)
            size = part.num_rows
            named, row = flat(part["keys"]), np.repeat(np.arange(size), lengths(part["keys"]))
            place = np.minimum(np.searchsorted(names, named), len(names) - 1)
            row, place = row[names[place] == named], place[names[place] == named]
            posting, count = row[np.argsort(place, kind="stable")], np.bincount(place, minlength=len(names))
            start = np.cumsum(count) - count
            heavy = np.flatnonzero(count > size // 8)  # a product with a few full rows instead of lists
            full = np.zeros((len(heavy), size))
            for i, h in enumerate(heavy):
                full[i, posting[start[h] : start[h] + count[h]]] = 1
            light = count.copy()
            light[heavy] = 0
            for c in range(len(top)):
                first, last = c * TOGETHER, min((c + 1) * TOGETHER, q.num_rows)
                e = slice(ends[first], ends[last])
                mine, what, w = asked[e] - first, code[e], ws[e]
                dense = np.zeros((last - first, len(heavy)))
                spot = np.minimum(np.searchsorted(heavy, what), max(0, len(heavy) - 1))
                is_heavy = heavy[spot] == what if len(heavy) else np.zeros(len(what), bool)
                dense[mine[is_heavy], spot[is_heavy]] = w[is_heavy]
                score = dense @ full
                n = light[what]
                skip = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                np.add.at(score.reshape(-1), np.repeat(mine * size, n) + posting[np.repeat(start[what], n) + skip], np.repeat(w, n))
                x, y = np.nonzero(score > least[first:last, None])
                if len(x):
                    a, b, d = (np.r_[old, new] for old, new in zip(top[c], (x, score[x, y].astype(np.int64), y + at), strict=True))
                    by = np.lexsort((d, -b, a))
                    a, b, d = a[by], b[by], d[by]
                    rank = np.arange(len(a)) - np.searchsorted(a, a)
                    least[first + a[rank == k - 1]] = b[rank == k - 1]
                    top[c] = [z[rank < k] for z in (a, b, d)]
            at, wide = at + size, min(2 * wide, SLICE)
        a, b, d = (np.concatenate([np.zeros(0, np.int64), *z]) for z in ([t[0] + c * TOGETHER for c, t in enumerate(top)], [t[1] for t in top], [t[2] for t in top]))
        return pa.table({"query": q["query"].take(pa.array(a)), "reaction": r["reaction"].take(pa.array(d)), "s": pa.array(b)})

    met = left.groupBy("__qb", "__rb").cogroup(right.groupBy("__qb", "__rb")).applyInArrow(best, "query long, reaction long, s long")
    met = met.withColumn("__at", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("s"), "reaction"))).where(F.col("__at") <= k)
    return met.select("query", "reaction", (F.col("s") / F.lit(1e9)).alias("score"))


def ranked_in_blocks(asked: DataFrame, used: DataFrame, *, ordered: bool = True, store: DataFrame | None = None, centres: DataFrame | None = None) -> DataFrame:
    """:func:`ranked` of what ``asked`` finds in ``used`` (``reaction, is_product, molecule``, a bag); ordered: by query, then best first, ties to the least reaction.

    ``asked`` has component hits ``query, component_no, is_product, molecule, t`` or, with a ``store`` of sets (``molecule, fp, codes``), a row per component, ``query, is_product, asked, fp, codes``:
    it hits the sets that share a code with its own, its similarity is theirs (not ordered, no similarity is asked for: codes are sent without bits, a molecule's together). Ranges of queries meet blocks of reactions, query after query, and results leave as they are made: neither
    hits of sets nor pairs of a query and a reaction are shuffled. Results of one block are in order as they are made; those of several are sorted.
    With ``centres`` (``id, reaction_center`` of reactions and queries, each once; not with a ``store``) a query meets the reactions of its centre only, as in :func:`same_centre`.
    """
    spark = used.sparkSession
    key = (F.col("molecule") * 2 + F.col("is_product").cast("long")).alias("key")
    used = used.where("is_product is not null")
    asked = asked.where("is_product is not null")
    if centres is not None:  # the least id with a centre is its name
        known = centres.where("reaction_center <> ''")
        known = known.join(known.groupBy("reaction_center").agg(F.min("id").alias("centre")), "reaction_center").select("id", "centre")
        asked = asked.join(known.select(F.col("id").alias("query")), "query", "left_semi")
    queries = asked.select("query").distinct()
    count = queries.count()
    blocks = max(1, -(-used.agg(F.approx_count_distinct("reaction", 0.02)).first()[0] // (BLOCK if centres is None else CENTRED)))
    ranges = max(1, -(-count // ASKED), min(count, -(-spark.sparkContext.defaultParallelism // blocks)))
    bounds = queries.approxQuantile("query", [i / ranges for i in range(1, ranges)], 0.001) if ranges > 1 else []
    own = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda x: F.col("query") > x)) if bounds else F.lit(0)
    block = F.pmod(F.xxhash64("reaction"), F.lit(blocks)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    none = F.lit(None).cast("array<long>")

    def rows(df: DataFrame, kind: int, id_: str, *, bits: Column = F.lit(None), a: Column = none, b: Column = none, c: Column = none) -> DataFrame:
        """What goes to a task: its number, and rows of one kind."""
        place = (F.col("__q") * blocks + F.col("__r")).cast("int").alias("place")
        return df.select(place, F.lit(kind).alias("kind"), F.col(id_).cast("long").alias("id"), bits.cast("array<int>").alias("bits"), a.cast("array<long>").alias("a"), b.cast("array<long>").alias("b"), c.cast("array<long>").alias("c"), F.lit(None).cast("long").alias("centre") if centres is None else F.col("centre"))

    held = used.groupBy("reaction").agg(F.collect_set(key).alias("keys"))
    held = (held if centres is None else held.join(known.withColumnRenamed("id", "reaction"), "reaction")).select("*", block.alias("__r")).select("*", every(ranges).alias("__q"))
    parts = [rows(held, 0, "reaction", a=F.col("keys"))]
    if store is None:
        weights = asked.select("query", "component_no", key, "t").distinct().groupBy("query", "key").agg(F.sum(F.round(F.col("t") * 1e9).cast("long")).alias("w"), F.count(F.lit(1)).alias("n"))
        weights = weights.groupBy("query").agg(F.collect_list(F.struct("key", "w", "n")).alias("x"))
        weights = (weights if centres is None else weights.join(known.withColumnRenamed("id", "query"), "query")).select("*", own.alias("__q")).select("*", every(blocks).alias("__r"))
        parts.append(rows(weights, 2, "query", a=F.col("x.key"), b=F.col("x.w"), c=F.col("x.n")))
    else:
        needed = used.select(block.alias("__r"), "molecule").distinct()
        if not ordered:
            store = store.groupBy("molecule").agg(F.array_distinct(F.flatten(F.collect_list("codes"))).alias("codes")).withColumn("fp", F.lit(None))
            asked = asked.withColumn("fp", F.lit(None))
        sets = (store.join(needed, "molecule") if blocks > 1 else store.select("*", F.lit(0).alias("__r"))).select("*", every(ranges).alias("__q"))
        asked = asked.select("*", own.alias("__q")).select("*", every(blocks).alias("__r"))
        parts += [rows(sets, 1, "molecule", bits=F.col("fp"), a=F.col("codes")), rows(asked, 2, "query", bits=F.col("fp"), a=F.col("codes"), c=F.array(F.col("is_product").cast("long"), F.col("asked")))]
    both = parts[0]
    for x in parts[1:]:
        both = both.unionAll(x)
    by_sets, by_centre = store is not None, centres is not None
    flat = lambda column: pc.list_flatten(column.combine_chunks()).to_numpy(zero_copy_only=False)
    lengths = lambda column: pc.list_value_length(column.combine_chunks()).to_numpy(zero_copy_only=False).astype(np.int64)

    def postings(names: np.ndarray, values: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows by name, and where each name's begin."""
        place = np.minimum(np.searchsorted(names, values), max(0, len(names) - 1))
        met = names[place] == values if len(names) else np.zeros(len(values), bool)
        row, place = row[met], place[met]
        return row[np.argsort(place, kind="stable")].astype(np.int32), np.r_[0, np.cumsum(np.bincount(place, minlength=len(names)))]

    def hits_of_sets(s: pa.Table, q: pa.Table, molecules: np.ndarray):
        """Of a row of ``q``: places of the molecules that its set hits, their billionths added up, their number of scores."""
        own = s["id"].to_numpy()
        place = np.minimum(np.searchsorted(molecules, own), len(molecules) - 1)
        order = np.flatnonzero(molecules[place] == own)
        order = order[np.argsort(place[order], kind="stable")]
        codes = flat(q["a"])
        code_ends = np.r_[0, np.cumsum(lengths(q["a"]))].astype(np.int64)
        keys = np.unique(codes)
        if not ordered:
            of, some = place[order], s.select(["a"]).take(pa.array(order))
            by_code = postings(keys, flat(some["a"]), np.repeat(of, lengths(some["a"])))

            def met(at: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
                found = np.zeros(len(molecules), bool)
                for i in np.searchsorted(keys, codes[code_ends[at] : code_ends[at + 1]]):
                    found[by_code[0][by_code[1][i] : by_code[1][i + 1]]] = True
                found = np.flatnonzero(found)
                return found, np.zeros(len(found), np.int64), np.ones(len(found), np.int64)

            return met
        bits = flat(q["bits"])
        bit_ends = np.r_[0, np.cumsum(lengths(q["bits"]))].astype(np.int64)
        names = np.unique(bits)
        pieces = []
        for at in range(0, len(order), SETS):
            some = s.take(pa.array(order[at : at + SETS]))
            sizes, row = lengths(some["bits"]), np.arange(some.num_rows)
            pieces.append((place[order[at : at + SETS]], sizes.astype(np.int32), postings(names, flat(some["bits"]), np.repeat(row, sizes)), postings(keys, flat(some["a"]), np.repeat(row, lengths(some["a"])))))
        listed = lambda lists, at: np.concatenate([np.zeros(0, np.int32), *(lists[0][lists[1][i] : lists[1][i + 1]] for i in at)])

        def hits(at: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            mine = bits[bit_ends[at] : bit_ends[at + 1]]
            spots, own_keys = np.searchsorted(names, mine), np.searchsorted(keys, codes[code_ends[at] : code_ends[at + 1]])
            one = [np.zeros(0, np.int64)]
            for of, sizes, by_bit, by_code in pieces:
                met = np.zeros(len(of), bool)
                met[listed(by_code, own_keys)] = True
                met = np.flatnonzero(met)
                i = np.bincount(listed(by_bit, spots), minlength=len(of))[met]
                u = len(mine) + sizes[met] - i
                one.append(of[met] << 30 | (i * 2_000_000_000 + u) // (2 * u))
            one = np.unique(np.concatenate(one))  # a molecule's scores, each once
            molecule, first = np.unique(one >> 30, return_index=True)
            t = one & ((1 << 30) - 1)
            return molecule, np.add.reduceat(t, first) if len(t) else t, np.diff(np.r_[first, len(t)])

        return hits

    def answers(r: pa.Table, s: pa.Table | None, q: pa.Table):
        place = pc.sort_indices(r.select(["centre", "id"]), [(c, "ascending") for c in ("centre", "id")[not by_centre :]], null_placement="at_start")
        reactions, centre, r = r["id"].take(place).combine_chunks(), r["centre"].take(place), r.select(["a"]).take(place)
        q = q.take(pc.sort_indices(q["id"]))
        n = lengths(r["a"])
        start = np.r_[0, np.cumsum(n)].astype(np.int64)
        molecules = np.unique(np.concatenate([np.zeros(0, np.int64), *(np.unique(flat(r["a"].slice(i, ROWS)) >> 1) for i in range(0, len(n), ROWS))]))
        code = np.empty(start[-1], np.int32)
        for i in range(0, len(n), ROWS):  # a piece at a time: what sorting takes would else be the most that a worker holds
            keys, row = flat(r["a"].slice(i, ROWS)), np.repeat(np.arange(len(n[i : i + ROWS])), n[i : i + ROWS])
            keys = keys[np.lexsort((keys, row))]
            code[start[i] : start[i] + len(keys)] = np.searchsorted(molecules, keys >> 1) * 2 + (keys & 1)
        twin = np.r_[False, code[1:] >> 1 == code[:-1] >> 1]
        twin[start[:-1]] = False
        asked = q["id"].to_numpy()
        first = np.flatnonzero(np.r_[True, asked[1:] != asked[:-1]])
        ends = np.r_[0, np.cumsum(lengths(q["a"]))].astype(np.int64)
        if by_sets:
            hits, kept, about = (hits_of_sets(s, q, molecules) if s is not None else None), {}, flat(q["c"])
        else:
            key, ws, ns = (flat(q[c]) for c in "abc")
            place = np.minimum(np.searchsorted(molecules, key >> 1), len(molecules) - 1)
            known, place = molecules[place] == key >> 1, place * 2 + (key & 1)
        text = pa.array(molecules).cast(pa.string())
        if not by_sets:  # the others are never written
            met = np.zeros(len(molecules), bool)
            met[place[known] >> 1] = True
            text = pc.if_else(pa.array(met), text, "")
        written = [text]
        for _ in range(1, min(TIMES, TIMES if by_sets else int(ns.max(initial=1))) if ordered else 1):
            written.append(pc.binary_join_element_wise(written[-1], text, ","))
        names, whole = pa.concat_arrays(written), (code, twin, start, reactions)
        if by_centre:
            begins, beyond = (np.searchsorted(centre.to_numpy(), q["centre"].to_numpy(), side) for side in ("left", "right"))
        del r, s, keys, n, row, written, text

        def of_centres(at: int, to: int) -> tuple:
            """``whole`` of the reactions that have one of the centres of a query, which has a row for each."""
            code, twin, start, reactions = whole
            if to - at == 1:
                i, j = begins[at], beyond[at]
                return code[start[i] : start[j]], twin[start[i] : start[j]], start[i : j + 1] - start[i], reactions.slice(i, j - i)
            some = np.concatenate([np.arange(begins[x], beyond[x]) for x in range(at, to)])
            some = some[np.argsort(reactions.to_numpy()[some], kind="stable")]
            n = start[some + 1] - start[some]
            first = np.r_[0, np.cumsum(n)]
            keys = np.arange(first[-1]) + np.repeat(start[some] - first[:-1], n)
            return code[keys], twin[keys], first, reactions.take(pa.array(some))

        weight, times = np.zeros((2, 2 * len(molecules)), np.int64)
        for at, to in zip(first, np.r_[first[1:], len(asked)], strict=True):
            weight[:], times[:] = 0, 0
            code, twin, start, reactions = of_centres(at, to) if by_centre else whole
            if not len(reactions):
                continue
            if by_sets:
                for i in range(at, to if hits else at):
                    role, name = about[2 * i], about[2 * i + 1]
                    kept[name] = found = kept.pop(name) if name in kept else hits(i)  # the last asked are kept
                    if len(kept) > KEPT:
                        kept.pop(next(iter(kept)))
                    spot = found[0] * 2 + role
                    weight[spot] += found[1]
                    times[spot] += found[2]
            else:
                mine = slice(ends[at], ends[at + 1])
                spot = place[mine][known[mine]]
                weight[spot], times[spot] = ws[mine][known[mine]], ns[mine][known[mine]]
            many = times[code]
            if not ordered:
                many = many > 0
                many = (many & ~(twin & np.r_[False, many[:-1]])).astype(np.int64)  # a molecule in both roles is one
            if ordered and (most := times.max(initial=0)) > TIMES:
                parts = (many + TIMES - 1) // TIMES
            else:
                most, parts = 0, (many > 0).astype(np.int64) if ordered else many
            matched = np.add.reduceat(parts, start[:-1])
            row = np.flatnonzero(matched)
            if not len(row):
                continue
            texts = []
            for i in range(0, len(row), ROWS):
                some = row[i : i + ROWS]
                of = slice(start[some[0]], start[some[-1] + 1])
                if most:  # whole parts, the rest last
                    n = parts[of]
                    size = np.full(n.sum(), TIMES)
                    size[(np.cumsum(n) - 1)[n > 0]] = (many[of] - (n - 1) * TIMES)[n > 0]
                    what = np.repeat(code[of] >> 1, n) + (size - 1) * len(molecules)
                else:
                    shown = np.flatnonzero(parts[of])
                    what = (code[of][shown] >> 1) + (many[of][shown] - 1) * len(molecules)
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(matched[some])], pa.int32()), names.take(pa.array(what)))
                texts.append(pc.binary_join(lists, ","))
            text = pa.chunked_array(texts).combine_chunks()
            if ordered:
                score = np.add.reduceat(weight[code], start[:-1])[row]
                order = np.argsort(-score, kind="stable")
                row, text, score = row[order], text.take(pa.array(order)), score[order] / 1e9
            else:
                score = matched[row].astype(np.float64)
            del many, parts, matched, lists, texts
            pa.default_memory_pool().release_unused()
            yield from pa.table({"query": np.full(len(row), asked[at]), "reaction": reactions.take(pa.array(row)), "molecules": text, "score": score}).to_batches(max_chunksize=ROWS)

    def find(batches):
        of: dict[int, dict[int, list[pa.RecordBatch]]] = {}
        for b in batches:
            what = b["place"].to_numpy().astype(np.int64) * 3 + b["kind"].to_numpy()
            for x in np.unique(what):
                of.setdefault(int(x) // 3, {}).setdefault(int(x) % 3, []).append(b.filter(pa.array(what == x)))
        for p in sorted(of):
            rows = {k: pa.Table.from_batches(x) for k, x in of.pop(p).items()}
            if 0 in rows and 2 in rows:
                yield from answers(rows.pop(0), rows.pop(1, None), rows.pop(2))

    found = both.repartitionById(ranges * blocks, "place").mapInArrow(find, "query long, reaction long, molecules string, score double")
    return found.orderBy("query", F.desc("score"), "reaction") if ordered and blocks > 1 else found


def similar_in_blocks(asked: DataFrame, store: DataFrame, used: DataFrame) -> DataFrame:
    """``query, reaction, molecule, t``, each once: reactions that use a molecule with a set that shares a code with the query's.

    ``asked`` has ``query, fp, codes``, ``store`` ``molecule, fp, codes`` (a molecule may have several sets) and ``used`` ``reaction, molecule``, a bag. Blocks have molecules with
    all their sets and uses, so only queries are sent more than once; results leave as they are made. Pairs of sets and lifted ones are never shuffled.
    """
    parallel = used.sparkSession.sparkContext.defaultParallelism
    blocks = max(parallel, -(-store.count() // STORED))
    rows = lambda df, kind, place, id_, bits, a: df.select(place.cast("int").alias("place"), F.lit(kind).alias("kind"), F.col(id_).cast("long").alias("id"), bits.cast("array<int>").alias("bits"), a.cast("array<long>").alias("a"))
    own = F.pmod(F.xxhash64("molecule"), F.lit(blocks))
    uses = used.where("molecule is not null").select("molecule", "reaction").distinct().select("molecule", F.array("reaction").alias("a"))
    both = rows(uses, 0, own, "molecule", F.lit(None), F.col("a"))
    both = both.unionAll(rows(store.where("molecule is not null"), 1, own, "molecule", F.col("fp"), F.col("codes")))
    both = both.unionAll(rows(asked.select("*", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("__b")), 2, F.col("__b"), "query", F.col("fp"), F.col("codes")))
    flat = lambda column: pc.list_flatten(column.combine_chunks()).to_numpy(zero_copy_only=False)
    lengths = lambda column: pc.list_value_length(column.combine_chunks()).to_numpy(zero_copy_only=False).astype(np.int64)

    def postings(names: np.ndarray, values: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows by name, and where each name's begin."""
        place = np.minimum(np.searchsorted(names, values), max(0, len(names) - 1))
        met = names[place] == values if len(names) else np.zeros(len(values), bool)
        row, place = row[met], place[met]
        return row[np.argsort(place, kind="stable")].astype(np.int32), np.r_[0, np.cumsum(np.bincount(place, minlength=len(names)))]

    def answers(u: pa.Table, s: pa.Table, q: pa.Table):
        u = u.take(pc.sort_indices(u["id"]))
        molecules, start, count = np.unique(u["id"].to_numpy(), return_index=True, return_counts=True)
        reactions = pc.list_flatten(u["a"].combine_chunks())
        place = np.minimum(np.searchsorted(molecules, s["id"].to_numpy()), len(molecules) - 1)
        known = np.flatnonzero(molecules[place] == s["id"].to_numpy())
        place, s = place[known].astype(np.int64), s.take(pa.array(known))
        sizes, row = lengths(s["bits"]), np.arange(s.num_rows)
        bits, codes = flat(q["bits"]), flat(q["a"])
        bit_ends, code_ends = (np.r_[0, np.cumsum(lengths(q[c]))].astype(np.int64) for c in ("bits", "a"))
        names, keys = np.unique(bits), np.unique(codes)
        by_bit, by_code = postings(names, flat(s["bits"]), np.repeat(row, sizes)), postings(keys, flat(s["a"]), np.repeat(row, lengths(s["a"])))
        listed = lambda lists, at: np.concatenate([np.zeros(0, np.int32), *(lists[0][lists[1][i] : lists[1][i + 1]] for i in at)])
        for at, query in enumerate(q["id"].to_numpy()):
            mine = bits[bit_ends[at] : bit_ends[at + 1]]
            met = np.zeros(len(place), bool)
            met[listed(by_code, np.searchsorted(keys, codes[code_ends[at] : code_ends[at + 1]]))] = True
            met = np.flatnonzero(met)
            i = np.bincount(listed(by_bit, np.searchsorted(names, mine)), minlength=len(place))[met]
            both = len(mine) + sizes[met] - i
            one = np.unique(place[met] << 30 | (i * 2_000_000_000 + both) // (2 * both))  # a molecule's scores, each once
            of, t = one >> 30, (one & ((1 << 30) - 1)) / 1e9
            n = count[of]
            ends = np.cumsum(n)
            first = 0
            while first < len(of):  # some thousand rows at a time, or those of one molecule
                last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + ROWS, "right")))
                m = n[first:last]
                row = np.arange(m.sum()) + np.repeat(start[of[first:last]] - np.cumsum(m) + m, m)
                names_, scores = np.repeat(molecules[of[first:last]], m), np.repeat(t[first:last], m)
                yield from pa.table({"query": np.full(len(row), query), "reaction": reactions.take(pa.array(row)), "molecule": names_, "t": scores}).to_batches(max_chunksize=ROWS)
                first = last

    def find(batches):
        of: dict[int, dict[int, list[pa.RecordBatch]]] = {}
        for b in batches:
            what = b["place"].to_numpy().astype(np.int64) * 3 + b["kind"].to_numpy()
            for x in np.unique(what):
                of.setdefault(int(x) // 3, {}).setdefault(int(x) % 3, []).append(b.filter(pa.array(what == x)))
        for p in sorted(of):
            rows = {k: pa.Table.from_batches(x) for k, x in of.pop(p).items()}
            if len(rows) == 3:
                yield from answers(rows[0], rows[1], rows[2])

    return both.repartitionById(blocks, "place").mapInArrow(find, "query long, reaction long, molecule long, t double")


def same_centre(found: DataFrame, reactions: DataFrame) -> DataFrame:
    """Hits whose reaction centre equals the query's; a missing or empty centre equals none."""
    c = reactions.where("reaction_center is not null and reaction_center <> ''")
    q = c.select(F.col("id").alias("query"), F.col("reaction_center").alias("__c"))
    r = c.select(F.col("id").alias("reaction"), F.col("reaction_center").alias("__c"))
    return found.join(q, "query").join(r, ["reaction", "__c"]).drop("__c")


def unsearchable(asked: DataFrame, parts: DataFrame, searchable: DataFrame) -> DataFrame:
    """Queries none of whose components can be searched: reactions without a ``molecule`` in ``searchable``. A search for one of them is an error."""
    return asked.select("query").distinct().join(parts.join(searchable.distinct(), "molecule", "left_semi"), "query", "left_anti")


def require_searchable(asked: DataFrame, parts: DataFrame, searchable: DataFrame) -> None:
    """ValueError, with up to ten of them, if a query has no searchable component."""
    bad = [r["query"] for r in unsearchable(asked, parts, searchable).orderBy("query").limit(10).collect()]
    if bad:
        raise ValueError(f"no searchable component in reactions {bad}")


def of_sources(sources: DataFrame, links: DataFrame, records: DataFrame, key: str) -> DataFrame:
    """Records with the sources that a link table (``source`` and ``key``) gives them, once per link."""
    return links.distinct().join(sources.withColumnRenamed("id", "source"), "source").join(records, key)


def by_role(roles: DataFrame, parts: DataFrame) -> DataFrame:
    """``reaction, substances``: an array of ``struct<id, is_product, mapping, parts>`` in the order of ids.

    ``roles`` has ``id, reaction, substance, is_product, mapping``; ``parts`` ``id, substance, structure, mapping``.
    """
    uses = roles.where("is_product is not null")
    own = parts.groupBy("substance").agg(F.array_sort(F.collect_list(F.struct("id", "structure", "mapping"))).alias("parts"))
    return uses.join(own, "substance", "left").groupBy("reaction").agg(F.array_sort(F.collect_list(F.struct("id", "is_product", "mapping", "parts"))).alias("substances"))


def composed(roles: DataFrame, parts: DataFrame) -> DataFrame:
    """``reaction, key``: the condensed graph of each reaction's own molecules as text, null where it can't be composed; of :func:`by_role`."""
    return by_role(roles, parts).select("reaction", reaction_key("substances").alias("key"))
