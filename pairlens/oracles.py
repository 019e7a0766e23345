"""The queries of ``pairlens.queries`` in SQL, for checking results: the same tables, written down a second time."""

from __future__ import annotations

#: Fixed values, written out here so that the SQL does not follow what it checks: word characters, triangles, token paths.
WORDS, TRIANGLES, PATHS = r"[\p{L}\p{N}_]+", 10, 3
ATTRS = ["name", "brand", "type", "size"]
_all = lambda f, sep=", ": sep.join(f(a) for a in ATTRS)


def toks(prefix: str) -> str:
    return f"list_distinct(string_split(lower(concat_ws(' ', {_all(lambda a: prefix + a)})), ' '))"


def match(a: str, b: str) -> str:
    x, y = toks(a), toks(b)
    return f"cast(2 * len(list_intersect({x}, {y})) >= len(list_distinct(list_concat({x}, {y}))) as int)"


def words(expr: str) -> str:
    return f"regexp_extract_all(lower({expr}), '{WORDS}')"


def text(prefix: str) -> str:
    return f"concat_ws(' ', {_all(lambda a: prefix + a)})"


def same(a: str, b: str) -> str:
    return f"coalesce(list_sum(list_transform({a}, lambda x: len(list_filter({b}, lambda y: y = x)))), 0)"


def cosine(a: str, b: str) -> str:
    return f"case when len({a}) = 0 or len({b}) = 0 then 0.0 else {same(a, b)} / sqrt(cast({same(a, a)} * {same(b, b)} as double)) end"


SHOWN = f"ltable_id, {_all(lambda a: f'ltable_{a}')}, rtable_id, {_all(lambda a: f'rtable_{a}')}"
FREE = lambda a: f"case when side = 'L' then ltable_{a} else rtable_{a} end"
PIVOT = lambda a: f"case when side = 'L' then rtable_{a} else ltable_{a} end"
TID = "concat_ws('|', pair_id, side, cast(c_id as varchar))"
_on = lambda i: f"(mask & {1 << i}) <> 0"
NAME = "concat_ws('/', " + ", ".join(f"case when {_on(i)} then case when side = 'L' then 'ltable_{a}' else 'rtable_{a}' end end" for i, a in enumerate(ATTRS)) + ")"


def _side(side: str, other: str, source: str, own: str, their: str) -> str:
    return f"""select '{side}' as side, pair_id, decision, {SHOWN}, c.id as c_id, {_all(lambda a: f'c.{a} as c_{a}')}, coalesce(d.xy, 0) / sqrt(cast(c.xx * o.xx as double)) as score,
        {match('c.', f'm.{other}')} as c_decision from dec m cross join {source} c join {'rsrc_n' if side == 'L' else 'lsrc_n'} o on o.id = m.{other}id left join dots d on d.{own} = c.id and d.{their} = m.{other}id"""


def _cuts(side: str, other: str) -> str:
    return " union all ".join(f"""select '{side}' as side, pair_id, decision, {SHOWN}, '{a}' as attribute, kind, n, v, {_all(lambda b: f"{'v' if b == a else other + b} as c_{b}")} from (
        select *, case when kind = 'prefix' then array_to_string(w[1:n], ' ') else array_to_string(w[len(w) - n + 1:len(w)], ' ') end as v from (
        select *, unnest(range(1, len(w))) as n from (select *, string_split({other}{a}, ' ') as w from dec where pair_id in (select pair_id from short))) cross join (select unnest(['prefix', 'suffix']) as kind))""" for a in ATTRS)


CTE: dict[str, tuple[str, list[str]]] = {
    "rec": ("select p_partkey as id, p_name as name, p_brand as brand, p_type as type, cast(p_size as varchar) as size from part", []),
    "lsrc": ("select * from rec where id % 2 = 0", ["rec"]),
    "rsrc": ("select * from rec where id % 2 = 1", ["rec"]),
    "alike": ("select l.id as ltable_id, min(r.id) as rtable_id from lsrc l join rsrc r using (name, brand, type) group by l.id", ["lsrc", "rsrc"]),
    "pairs": ("""select ltable_id, rtable_id, 1 as label from alike union all select l.id, r.id, 0 from lsrc l join rsrc r on r.id = l.id + 1
        where not exists (select 1 from alike a where a.ltable_id = l.id and a.rtable_id = r.id)""", ["alike"]),
    "rows_": (f"""select concat('0@', ltable_id, '#1@', rtable_id) as pair_id, label, ltable_id, {_all(lambda a: f'l.{a} as ltable_{a}')}, rtable_id, {_all(lambda a: f'r.{a} as rtable_{a}')}
        from pairs join lsrc l on l.id = ltable_id join rsrc r on r.id = rtable_id""", ["pairs"]),
    "dec": (f"select *, {match('ltable_', 'rtable_')} as decision, {words(text('ltable_'))} as ltable_w, {words(text('rtable_'))} as rtable_w from rows_", ["rows_"]),
    "lw": (f"select id, w, count(*) as c from (select id, unnest({words(text(''))}) as w from lsrc) group by all", ["lsrc"]),
    "rw": (f"select id, w, count(*) as c from (select id, unnest({words(text(''))}) as w from rsrc) group by all", ["rsrc"]),
    "lsrc_n": ("select * from lsrc join (select id, sum(c * c) as xx from lw group by 1) using (id)", ["lsrc", "lw"]),
    "rsrc_n": ("select * from rsrc join (select id, sum(c * c) as xx from rw group by 1) using (id)", ["rsrc", "rw"]),
    "dots": ("select lw.id as lid, rw.id as rid, sum(lw.c * rw.c) as xy from lw join rw using (w) group by 1, 2", ["lw", "rw"]),
    "cand": (f"""select * from (select *, row_number() over (partition by pair_id, side order by case when decision = 0 then -score else score end, c_id) as place
        from ({_side('L', 'rtable_', 'lsrc_n', 'lid', 'rid')} union all {_side('R', 'ltable_', 'rsrc_n', 'rid', 'lid')})) where place <= {2 * TRIANGLES}""", ["dec", "lsrc_n", "rsrc_n", "dots"]),
    "short": (f"select pair_id from cand group by 1 having count(*) filter (c_decision <> decision) < {TRIANGLES}", ["cand"]),
    "copy": (f"""select side, pair_id, decision, {SHOWN}, c_id, {_all(lambda a: f'c_{a}')}, attribute, v, score, c_decision from (select *, row_number() over (partition by pair_id, side order by case when decision = 0 then -score else score end, c_id desc) as place from (
        select *, {cosine('o_w', 'c_w')} as score, case when side = 'L' then {match('c_', 'rtable_')} else {match('ltable_', 'c_')} end as c_decision from (
        select *, -row_number() over (partition by pair_id, side order by attribute, n, kind, v) as c_id, {words(text('c_'))} as c_w, case when side = 'L' then {words(text('rtable_'))} else {words(text('ltable_'))} end as o_w
        from ({_cuts('L', 'rtable_')} union all {_cuts('R', 'ltable_')})))) where place <= {2 * TRIANGLES}""", ["dec", "short"]),
    "cand_all": (f"select side, pair_id, decision, {SHOWN}, c_id, {_all(lambda a: f'c_{a}')}, score, c_decision from cand union all select side, pair_id, decision, {SHOWN}, c_id, {_all(lambda a: f'c_{a}')}, score, c_decision from copy", ["cand", "copy"]),
    "bal": (f"""select * from (select *, row_number() over (partition by pair_id order by side, rank) as ord, count(*) over (partition by pair_id) as t from (
        select *, case when count(distinct side) over (partition by pair_id) > 1 then min(n) over (partition by pair_id) else max(n) over (partition by pair_id) end as k from (
        select *, count(*) over (partition by pair_id, side) as n, row_number() over (partition by pair_id, side order by md5(concat(side, '@', c_id)), c_id) as rank from cand_all where c_decision <> decision)) where rank <= k)
        where ord <= {TRIANGLES // 2} or ord > t - {TRIANGLES // 2} or t <= {TRIANGLES}""", ["cand_all"]),
    "pert": (f"""select pair_id, {TID} as triangle_id, side, decision, mask,
        {', '.join(f"case when side = 'L' and {_on(i)} then c_{a} else ltable_{a} end as ltable_{a}" for i, a in enumerate(ATTRS))},
        {', '.join(f"case when side = 'R' and {_on(i)} then c_{a} else rtable_{a} end as rtable_{a}" for i, a in enumerate(ATTRS))},
        concat_ws('|', {', '.join(f"case when {_on(i)} then {FREE(a)} end" for i, a in enumerate(ATTRS))}) as dropped,
        concat_ws('|', {', '.join(f"case when {_on(i)} then c_{a} end" for i, a in enumerate(ATTRS))}) as copied
        from bal cross join (select unnest(range(1, {(1 << len(ATTRS)) - 1})) as mask)""", ["bal"]),
    "flip_": (f"select *, cast({match('ltable_', 'rtable_')} <> decision as int) as flip from pert", ["pert"]),
    "ranks": ("select pair_id, side, mask, sum(flip) as flips, count(*) as tried from flip_ group by all", ["flip_"]),
    "suff": ("select r.*, flips / n as sufficiency from ranks r join (select pair_id, count(*) as n from bal group by 1) using (pair_id)", ["ranks", "bal"]),
    "sal": ("select pair_id, feature, case when f_all > 0 then f / f_all else 0.0 end as saliency from (" + " union all ".join(
        f"select pair_id, '{p}{a}' as feature, sum(case when side = '{s}' and {_on(i)} then flips else 0 end) as f, sum(flips) as f_all from ranks group by 1" for s, p in (("L", "ltable_"), ("R", "rtable_")) for i, a in enumerate(ATTRS)) + ")", ["ranks"]),
    "best": ("""select b.* from (select * from (select *, max(sufficiency) over (partition by pair_id) as m from suff) where sufficiency = m and sufficiency > 0) b
        where not exists (select 1 from (select *, max(sufficiency) over (partition by pair_id) as m from suff) o where o.sufficiency = o.m and o.sufficiency > 0 and o.pair_id = b.pair_id and o.side = b.side and o.mask <> b.mask and (o.mask & b.mask) = o.mask)""", ["suff"]),
    "cf": (f"""select *, bit_count(mask) as attr_count, row_number() over (partition by pair_id order by bit_count(mask), side, mask, copied, dropped) as place from (
        select f.pair_id, f.side, f.mask, dropped, copied, min(triangle_id) as triangle_id, {_all(lambda a: f'min(ltable_{a}) as ltable_{a}, min(rtable_{a}) as rtable_{a}')}
        from flip_ f join best b on f.pair_id = b.pair_id and f.side = b.side and f.mask = b.mask where flip = 1 group by f.pair_id, f.side, f.mask, dropped, copied)""", ["flip_", "best"]),
    # a mask is a union of found ones if it is the union of all found ones inside it; likewise for intersections
    "found_": ("select distinct pair_id, side, mask from cf", ["cf"]),
    "joins_": ("select pair_id, side, x as mask from found_ cross join (select unnest(range(16)) as x) where (mask & x) = mask group by 1, 2, 3 having bit_or(mask) = x", ["found_"]),
    "closed_": ("select pair_id, side, x as mask from joins_ cross join (select unnest(range(16)) as x) where (mask & x) = x group by 1, 2, 3 having bit_and(mask) = x", ["joins_"]),
    "truth_": ("select id as ltable_id, id as rtable_id, 1 as label from rec union all select a.id, b.id, 0 from rec a join rec b on b.id = a.id + 1", ["rec"]),
    "spans": ("""select *, case when was is distinct from now then row_number() over (partition by triangle_id, path, was is distinct from now order by md5(concat_ws('|', path, attribute, position))) end as step from (
        select pair_id, side, decision, triangle_id, attribute, position, was, now, unnest(range(""" + str(PATHS) + """)) as path from (
        select pair_id, side, decision, triangle_id, attribute, p as position, case when p < len(f) then f[p + 1] end as was, case when p < len(s) then s[p + 1] end as now from (
        select *, unnest(range(greatest(len(f), len(s)))) as p from (""" + " union all ".join(f"select pair_id, side, decision, {TID} as triangle_id, '{a}' as attribute, string_split({FREE(a)}, ' ') as f, string_split(c_{a}, ' ') as s from bal" for a in ATTRS) + "))))", ["bal"]),
    "steps": (f"""select v.pair_id, v.triangle_id, v.path, v.step, altered, cast({match('v.f_', 'p.p_')} <> v.decision as int) as flip from (
        select s.pair_id, s.decision, s.triangle_id, s.path, n.step, {', '.join(f"coalesce(string_agg(case when attribute = '{a}' then case when s.step <= n.step then now else was end end, ' ' order by position), '') as f_{a}" for a in ATTRS)},
        list_sort(list(concat(case when side = 'L' then 'ltable_' else 'rtable_' end, attribute, '__', coalesce(was, ''))) filter (s.step <= n.step)) as altered
        from spans s join (select triangle_id, path, unnest(range(1, max(step) + 1)) as step from spans where step is not null group by 1, 2) n on s.triangle_id = n.triangle_id and s.path = n.path
        group by s.pair_id, s.decision, s.triangle_id, s.path, n.step) v
        join (select {TID} as triangle_id, {_all(lambda a: f'{PIVOT(a)} as p_{a}')} from bal) p on v.triangle_id = p.triangle_id""", ["spans", "bal"]),
    "tsal": ("""select pair_id, feature, count(*) / f_all as saliency from (select pair_id, f_all, unnest(altered) as feature from (select *, count(*) over (partition by pair_id) as f_all from steps where flip = 1)) group by pair_id, feature, f_all""", ["steps"]),
    "draws": ("select pair_id, d as draw, feature, ((ascii(md5(concat(d, feature, pair_id))[1:1]) % 7) - 1) / 5.0 as score from sal cross join (select unnest(range(3)) as d)", ["sal"]),
    "top3": ("select * from (select *, row_number() over (partition by pair_id, draw order by score desc, feature) as place from draws where score > 0) where place <= 3", ["draws"]),
    "ranked_a": ("select pair_id, list(feature order by saliency desc, feature) as a from sal group by 1", ["sal"]),
    "ranked_b": ("select pair_id, list(feature order by score desc, feature) as b from draws where draw = 0 group by 1", ["draws"]),
    "lists": ("select pair_id, a, b from ranked_a join ranked_b using (pair_id)", ["ranked_a", "ranked_b"]),
    "cf1": ("select * from cf where place = 1", ["cf"]),
    "cfd": (f"""select c.pair_id, {' + '.join(f"cast(c.{p}{a} is not distinct from r.{p}{a} as int)" for p in ('ltable_', 'rtable_') for a in ATTRS)} as same_n from cf1 c join rows_ r using (pair_id)""", ["cf1", "rows_"]),
    "changed": (f"""select c.pair_id, list_sort(list_filter([{', '.join(f"case when c.{p}{a} is distinct from r.{p}{a} then '{p}{a}' end" for p in ('ltable_', 'rtable_') for a in ATTRS)}], lambda x: x is not null)) as changed from cf1 c join rows_ r using (pair_id)""", ["cf1", "rows_"]),
    "docpairs": ("select a.doc_id, a.text as x, b.text as y from documents a join documents b on b.doc_id = a.doc_id + 1", []),
    "dcount": (f"select doc_id, 'x' as s, w, count(*) as c from (select doc_id, unnest(regexp_extract_all(x, '{WORDS}')) as w from docpairs) group by all union all select doc_id, 'y', w, count(*) from (select doc_id, unnest(regexp_extract_all(y, '{WORDS}')) as w from docpairs) group by all", ["docpairs"]),
}


def sql(query: str, *needs: str) -> str:
    order: list[str] = []

    def add(name: str) -> None:
        for n in CTE[name][1]:
            add(n)
        if name not in order:
            order.append(name)

    for n in needs:
        add(n)
    return ("with " + ",\n".join(f"{n} as materialized ({CTE[n][0]})" for n in order) + "\n" if order else "") + query


#: The words that noise replaces, and their short forms.
FORMS = {"stainless": ["ss", "inox"], "package": ["pkg", "pack"], "hardware": ["hdw", "hw"], "kilogram": ["kg", "kilo"], "portable": ["port."], "cylinder": ["cyl"]}


def noisy(value: str, salt: str, level: str) -> str:
    """A value of the record ``id`` as noise of a level leaves it: words are numbered from 0 and change by draws from md5."""
    pick = lambda what, n: f"(('0x' || substr(md5(concat(id, '#', {what})), 1, 8))::bigint % {n})"
    draw = lambda what, n: pick(f"concat('{salt}.{what}.', i - 1)", n)
    place = f"({draw('place', 1 << 16)} % greatest(length(w), 1))"
    other = "case " + " ".join(f"when contains(lower(w), '{name}') then [{', '.join(repr(f) for f in forms)}][{draw('form', len(forms))} + 1]" for name, forms in reversed(FORMS.items())) + " else w end"
    word = f"""case when not ({draw('whether', 10)} < {level} and w <> '') then w when {draw('kind', 10)} < 4 then concat(w[1:{place}], 'abcdefghijklmnopqrstuvwxyz'[{draw('letter', 26)} + 1], w[{place} + 2:])
        when {draw('kind', 10)} < 6 then concat(case when length(w) > 3 then w[1:3] else w[1:1] end, '.') when {draw('kind', 10)} < 8 then {other} else w[1:greatest({place}, 1)] end"""
    done = f"list_transform(string_split({value}, ' '), lambda w, i: {word})"
    return f"case when {value} is not null then array_to_string(case when {pick(f"'{salt}.swap'", 10)} = 0 and len(string_split({value}, ' ')) > 1 then list_concat(({done})[2:2], ({done})[1:1], ({done})[3:]) else {done} end, ' ') end"


def copies(salt: str, levels: str) -> str:
    return f"select id, level, {_all(lambda a: f'{noisy(a, f"{salt}.{a}", "level")} as {a}')} from rec cross join (select unnest({levels}) as level)"


R6 = "round({}, 6)"
TOP2 = "list_sort(a[1:2])"
ORACLES: dict[str, str] = {
    "pair_merge": sql(f"select pair_id, label, {SHOWN} from rows_", "rows_"),
    "pair_merge_robust": sql(f"""select 'pair' as kind, label, {SHOWN} from rows_ union all
        select 'mirror', label, rtable_id, {_all(lambda a: f'rtable_{a}')}, ltable_id, {_all(lambda a: f'ltable_{a}')} from rows_ union all
        select 'left', 1, ltable_id, {_all(lambda a: f'ltable_{a}')}, ltable_id, {_all(lambda a: f'ltable_{a}')} from rows_ union all
        select 'right', 1, rtable_id, {_all(lambda a: f'rtable_{a}')}, rtable_id, {_all(lambda a: f'rtable_{a}')} from rows_""", "rows_"),
    "record_text": sql(f"select pair_id, {text('ltable_')} as left_text, {text('rtable_')} as right_text, concat_ws('\t', {_all(lambda a: f'ltable_{a}')}, {_all(lambda a: f'rtable_{a}')}, '0') as tsv from rows_", "rows_"),
    "tuple_map": sql(f"select pair_id, concat_ws(';', {_all(lambda a: f'concat({chr(39)}{a}={chr(39)}, coalesce(ltable_{a}, {chr(39)}nan{chr(39)}))')}) as left_tuple from rows_", "rows_"),
    "token_features": sql("select pair_id, concat(attribute, '__', t[p]) as feature, attribute, p - 1 as position from (select *, unnest(range(1, len(t) + 1)) as p from (" + " union all ".join(f"select pair_id, '{p}{a}' as attribute, string_split({p}{a}, ' ') as t from rows_" for p in ("ltable_", "rtable_") for a in ATTRS) + "))", "rows_"),
    "feature_attribute_counts": sql("select attribute, count(*) as tokens from (" + " union all ".join(f"select '{p}{a}' as attribute, unnest(string_split({p}{a}, ' ')) as t from rows_" for p in ("ltable_", "rtable_") for a in ATTRS) + ") group by 1", "rows_"),
    "record_lookup": sql("""select query_id, id, same from (select query_id, id, same, row_number() over (partition by query_id order by same desc, id) as k from (
        select q.id as query_id, r.id, cast(q.name = r.name as int) + cast(q.brand = r.brand as int) + cast(q.type = r.type as int) + cast(q.size = r.size as int) as same from lsrc q join rsrc r on q.name = r.name or q.brand = r.brand or q.type = r.type or q.size = r.size)) where k = 1""", "lsrc", "rsrc"),
    "cosine_pairs": sql("""select p.doc_id, round(coalesce(xy / sqrt(cast(xx * yy as double)), 0.0), 6) as cosine from docpairs p left join (
        select doc_id, sum(x.c * y.c) as xy, sum(x.c * x.c) as xx, sum(y.c * y.c) as yy from (select doc_id, w, c from dcount where s = 'x') x full join (select doc_id, w, c from dcount where s = 'y') y using (doc_id, w) group by 1) using (doc_id)""", "docpairs", "dcount"),
    "vector_cosine": """with d as (select a.vec_id, list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: cast(z[1] as double) * z[2])) as ab, list_sum(list_transform(a.embedding, lambda x: cast(x as double) * x)) as aa,
        list_sum(list_transform(b.embedding, lambda x: cast(x as double) * x)) as bb from embeddings a join embeddings b on b.vec_id = a.vec_id + 1) select vec_id, round(ab / (sqrt(aa) * sqrt(bb) + 1e-12), 5) as cosine from d""",
    "jaccard_distance": sql(f"select pair_id, round(1 - len(list_intersect({toks('ltable_')}, {toks('rtable_')})) / len(list_distinct(list_concat({toks('ltable_')}, {toks('rtable_')}))), 6) as distance from rows_", "rows_"),
    "token_symdiff": sql(f"""select pair_id, array_to_string(list_sort(list_concat(list_filter({toks('ltable_')}, lambda t: not list_contains({toks('rtable_')}, t)), list_filter({toks('rtable_')}, lambda t: not list_contains({toks('ltable_')}, t)))), ' ') as diff,
        concat_ws(',', {', '.join(f"case when ltable_{a} is distinct from rtable_{a} then '{a}' end" for a in ATTRS)}) as changed from rows_""", "rows_"),
    "tfidf_cosine": sql("""select pair_id, round(coalesce(xy / nullif(sqrt(xx) * sqrt(yy), 0), 0.0), 6) as cosine from (select pair_id,
        list_sum(list_transform(list_distinct(list_concat(x, y)), lambda t: len(list_filter(x, lambda u: u = t)) * len(list_filter(y, lambda u: u = t)))) as xy,
        list_sum(list_transform(list_distinct(x), lambda t: power(len(list_filter(x, lambda u: u = t)) * case when list_contains(y, t) then 1.0 else ln(1.5) + 1 end, 2))) as xx,
        list_sum(list_transform(list_distinct(y), lambda t: power(len(list_filter(y, lambda u: u = t)) * case when list_contains(x, t) then 1.0 else ln(1.5) + 1 end, 2))) as yy
        from (select pair_id, string_split(lower(ltable_name), ' ') as x, string_split(lower(rtable_name), ' ') as y from rows_))""", "rows_"),
    "similarity_thresholds": sql(f"select label, round(avg(s), 6) as mean, round(stddev_samp(s), 6) as std, count(*) as n from (select label, {cosine('ltable_w', 'rtable_w')} as s from dec) group by 1", "dec"),
    "threshold_candidates": sql("select m.ltable_id, c.id as rtable_id, round(d.xy / sqrt(cast(o.xx * c.xx as double)), 6) as score from dec m join lsrc_n o on o.id = m.ltable_id join dots d on d.lid = m.ltable_id join rsrc_n c on c.id = d.rid where m.label = 1 and d.xy / sqrt(cast(o.xx * c.xx as double)) >= 0.6", "dec", "lsrc_n", "rsrc_n", "dots"),
    "candidate_topk": sql("select pair_id, side, c_id, place, round(score, 6) as score, c_decision from cand", "cand"),
    "match_scores": sql("select pair_id, label, cast(decision as double) as match_score, 1.0 - decision as nomatch_score from dec", "dec"),
    "match_f1": sql("select tp, fp, fn, round(2.0 * tp / (2 * tp + fp + fn), 6) as f1 from (select count(*) filter (label = 1 and decision = 1) as tp, count(*) filter (label = 0 and decision = 1) as fp, count(*) filter (label = 1 and decision = 0) as fn from dec)", "dec"),
    "ccc": "select round(2 * covar_pop(quality, toxic) / (var_pop(quality) + var_pop(toxic) + (avg(quality) - avg(toxic)) ** 2), 6) as ccc from labels",
    "equality_ratio": "select round(avg(cast(quality is not distinct from toxic as int)), 6) as ratio from labels",
    "few_shot": sql("select pair_id, label, example from (select pair_id, label, row_number() over (partition by label order by pair_id) as k, concat('record1:', " + text("ltable_") + ", chr(10), 'record2:', " + text("rtable_") + ", chr(10), 'prediction:', case when label = 1 then 'yes' else 'no' end) as example from rows_) where k <= 5", "rows_"),
    "support_set": sql("select pair_id, side, c_id, ord, decision from bal", "bal"),
    "subsequence_augment": sql(" union all ".join(f"select id, '{a}' as attribute, kind, n, {', '.join('v as ' + b if a == b else b for b in ATTRS)} from (select *, case when kind = 'prefix' then array_to_string(w[1:n], ' ') else array_to_string(w[len(w) - n + 1:len(w)], ' ') end as v from (select *, unnest(range(1, len(w))) as n from (select *, string_split({a}, ' ') as w from rec)) cross join (select unnest(['prefix', 'suffix']) as kind))" for a in ATTRS), "rec"),
    "triangles": sql(f"select pair_id, {TID} as triangle_id, side, case when side = 'L' then ltable_id else rtable_id end as free_id, case when side = 'L' then rtable_id else ltable_id end as pivot_id, c_id as support_id from bal", "bal"),
    "mixed_triangles": sql("select 'L' as side, p.ltable_id as free_id, p.rtable_id as pivot_id, n.ltable_id as support_id from pairs p join pairs n on p.rtable_id = n.rtable_id where p.label = 1 and n.label = 0 union all select 'R', p.rtable_id, p.ltable_id, n.rtable_id from pairs p join pairs n on p.ltable_id = n.ltable_id where p.label = 1 and n.label = 0", "pairs"),
    "attr_perturbations": sql("select triangle_id, mask, dropped, copied from pert", "pert"),
    "lattice_flips": sql(f"select pair_id, {NAME} as subset, flips, tried from ranks", "ranks"),
    "sufficiency": sql(f"select pair_id, {NAME} as subset, round(sufficiency, 6) as sufficiency from suff", "suff"),
    "attr_saliency": sql("select pair_id, feature, round(saliency, 6) as saliency from sal", "sal"),
    "cf_summary": sql(f"select pair_id, {NAME} as subset, round(sufficiency, 6) as sufficiency from best", "best"),
    "counterfactuals": sql("select pair_id, side, mask, dropped, copied, triangle_id, attr_count, place from cf", "cf"),
    "monotone_levels": sql("select triangle_id, min(case when a = 1 then level end) as level from (select triangle_id, bit_count(mask) as level, min(flip) as a from flip_ group by 1, 2) group by 1", "flip_"),
    "lattice_algebra": sql("""select pair_id, side, mask, case when mask in (select mask from found_ f where f.pair_id = c.pair_id and f.side = c.side) then 'found' when mask in (select mask from joins_ j where j.pair_id = c.pair_id and j.side = c.side) then 'join' else 'meet' end as origin,
        cast(mask in (select mask from found_ f where f.pair_id = c.pair_id and f.side = c.side) and not exists (select 1 from found_ f where f.pair_id = c.pair_id and f.side = c.side and f.mask <> c.mask and (f.mask & c.mask) = f.mask) as int) as minimal,
        cast(mask in (select mask from found_ f where f.pair_id = c.pair_id and f.side = c.side) and not exists (select 1 from found_ f where f.pair_id = c.pair_id and f.side = c.side and f.mask <> c.mask and (f.mask & c.mask) = c.mask) as int) as maximal from closed_ c""", "closed_"),
    "lattice_edges": sql("""select b.pair_id, b.side, b.mask as below, a.mask as above from closed_ b join closed_ a on a.pair_id = b.pair_id and a.side = b.side and a.mask <> b.mask and (a.mask & b.mask) = b.mask
        where not exists (select 1 from closed_ m where m.pair_id = b.pair_id and m.side = b.side and m.mask <> a.mask and m.mask <> b.mask and (m.mask & b.mask) = b.mask and (a.mask & m.mask) = m.mask)""", "closed_"),
    "triangle_properties": sql(f"""select triangle_id, cast({match('f_', 'f_')} + {match('p_', 'p_')} + {match('c_', 'c_')} = 3 as int) as identity,
        cast({match('f_', 'p_')} = {match('p_', 'f_')} and {match('p_', 'c_')} = {match('c_', 'p_')} and {match('f_', 'c_')} = {match('c_', 'f_')} as int) as symmetry,
        cast({match('f_', 'p_')} + {match('p_', 'c_')} + {match('f_', 'c_')} in (0, 1, 3) as int) as transitivity from (select {TID} as triangle_id, {_all(lambda a: f'{FREE(a)} as f_{a}, {PIVOT(a)} as p_{a}, c_{a}')} from bal)""", "bal"),
    "token_paths": sql("select triangle_id, path, step, array_to_string(altered, '/') as altered, flip from steps", "steps"),
    "token_saliency": sql("select pair_id, feature, round(saliency, 6) as saliency from tsal", "tsal"),
    "hybrid_freq": sql("select pair_id, feature, place from (select pair_id, feature, row_number() over (partition by pair_id order by times desc, feature) as place from (select pair_id, feature, count(*) as times from top3 group by 1, 2)) where place <= 3", "top3"),
    "hybrid_union": sql("select pair_id, feature, row_number() over (partition by pair_id order by first) as place from (select pair_id, feature, min(draw * 100 + place) as first from top3 group by 1, 2)", "top3"),
    "hybrid_intersection": sql("select pair_id, feature, row_number() over (partition by pair_id order by feature) as place from (select pair_id, feature from top3 group by 1, 2 having count(*) = 3)", "top3"),
    "rbo": sql("""select pair_id, round(len(list_intersect(a, b)) / greatest(len(a), len(b)) * power(0.9, greatest(len(a), len(b))) + (1 - 0.9) / 0.9 * list_sum(list_transform(range(1, greatest(len(a), len(b)) + 1), lambda d: power(0.9, d) * len(list_intersect(a[1:d], b[1:d])) / d)), 6) as rbo from lists""", "lists"),
    "kendall": sql("""select pair_id, round(2.0 * sum(sign(ascii_cmp_a) * sign(ascii_cmp_b)) / (8 * 7), 6) as tau from (select pair_id, case when a[i] < a[j] then 1 when a[i] > a[j] then -1 else 0 end as ascii_cmp_a, case when b[i] < b[j] then 1 when b[i] > b[j] then -1 else 0 end as ascii_cmp_b
        from lists cross join (select unnest(range(1, 9)) as i) cross join (select unnest(range(1, 9)) as j) where i < j) group by 1""", "lists"),
    "ndcg": sql("""select pair_id, round(case when len(list_filter(a, lambda x: list_contains(changed, x))) = 0 then 0.0 else list_sum(list_transform(range(1, len(a) + 1), lambda i: case when list_contains(changed, a[i]) then 1 / log2(i + 1) else 0.0 end))
        / list_sum(list_transform(range(1, len(list_filter(a, lambda x: list_contains(changed, x))) + 1), lambda i: 1 / log2(i + 1))) end, 6) as ndcg from ranked_a join changed using (pair_id)""", "ranked_a", "changed"),
    "topk_overlap": sql("select pair_id, k, round(len(list_intersect(a[1:k], changed)) / len(changed), 6) as overlap from ranked_a join changed using (pair_id) cross join (select unnest(range(1, 6)) as k) where len(changed) > 0", "ranked_a", "changed"),
    "cf_mass": sql("select pair_id, round(sum(case when list_contains(changed, feature) then saliency else 0.0 end), 6) as mass from sal join changed using (pair_id) group by 1", "sal", "changed"),
    "cf_alignment": sql("""select pair_id, round(b / len(y), 6) as coverage, round(b / len(x), 6) as prec, round(2.0 * b / (len(x) + len(y)), 6) as f1, round(b / (len(x) + len(y) - b), 6) as jaccard from (select pair_id, a[1:2] as x, changed as y, len(list_intersect(a[1:2], changed)) as b from ranked_a join changed using (pair_id)) where len(y) > 0""", "ranked_a", "changed"),
    "mass_consistency": sql("""select pair_id, round(sum(least(x, y)), 6) as mass from (select pair_id, attr as feature, s / sum(s) over (partition by pair_id) as x from (select pair_id, split_part(feature, '__', 1) as attr, sum(saliency) as s from tsal group by 1, 2)) t
        join (select pair_id, feature, case when sum(saliency) over (partition by pair_id) > 0 then saliency / sum(saliency) over (partition by pair_id) else 0.0 end as y from sal) using (pair_id, feature) group by 1""", "tsal", "sal"),
    "cf_metrics": sql("select pair_id, round(1 - same_n / 8, 6) as proximity, round(1 - (1 - same_n / 8) / 4, 6) as sparsity from cfd", "cfd"),
    "cf_diversity": sql("select pair_id, round(1 - same_n / (8 * n * n), 6) as diversity from (select pair_id, sum(c * c) as same_n from (" + " union all ".join(f"select pair_id, '{p}{a}' as f, {p}{a} as v, count(*) as c from cf group by 1, 2, 3" for p in ("ltable_", "rtable_") for a in ATTRS) + ") group by 1) join (select pair_id, count(*) as n from cf group by 1) using (pair_id)", "cf"),
    "cf_validity": sql(f"select pair_id, 1 - abs(new - decision) as validity from (select c.pair_id, d.decision, {match('c.ltable_', 'c.rtable_')} as new from cf1 c join dec d using (pair_id))", "cf1", "dec"),
    "faithfulness": sql(f"""select threshold, round(2.0 * tp / (2 * tp + fp + fn), 6) as f1 from (select threshold, count(*) filter (label = 1 and p = 1) as tp, count(*) filter (label = 0 and p = 1) as fp, count(*) filter (label = 1 and p = 0) as fn from (
        select threshold, label, {match('ltable_', 'rtable_')} as p from (select threshold, label, {', '.join(f"case when list_contains(a[1:k], '{p}{n}') then '' else {p}{n} end as {p}{n}" for p in ('ltable_', 'rtable_') for n in ATTRS)} from rows_ join ranked_a using (pair_id)
        cross join (select t as threshold, greatest(1, cast(floor(t * 9) as int)) as k from (select unnest([0.1, 0.33, 0.5, 0.7, 0.9]) as t)))) group by 1)""", "rows_", "ranked_a"),
    "concordance": sql(f"select pair_id, cast(d.decision = d.label as int) as agree, round({cosine('ltable_w', 'rtable_w')}, 6) as cos_sim from dec d", "dec"),
    "conversation_tokens": "select conv_id, cast(sum(len(string_split(text, ' '))) as bigint) as tokens, count(*) as turns from conversations where text is not null group by 1",
    "answer_to_match": "select event_id, case when event_id % 5 in (0, 2) then 1 when event_id % 5 = 4 and event_id % 2 = 0 then 1 else 0 end as match from events",
    "parse_answer": "select event_id, cast(event_id % 2 as int) as prediction, cast(user_id as double) as saliency, event_type as changed from events",
    "json_scores": "select event_id, round(cast(value as double), 6) as score from events",
    "judge_picks": "select pick, count(*) as n from (select case when event_id % 3 = 0 then 'system1' when event_id % 3 = 1 then 'system2' else 'tie' end as pick from events) group by 1",
    "noisy_sources": sql(f"""select concat('0@', ltable_id, '#1@', rtable_id) as pair_id, label, {SHOWN} from truth_ join (select id as ltable_id, {_all(lambda a: f'{a} as ltable_{a}')} from ({copies('l', '[5]')})) using (ltable_id)
        join (select id as rtable_id, {_all(lambda a: f'{a} as rtable_{a}')} from ({copies('r', '[8]')})) using (rtable_id)""", "truth_"),
    "noise_f1": sql(f"""select level, tp, fp, fn, round(2.0 * tp / (2 * tp + fp + fn), 6) as f1 from (select level, count(*) filter (label = 1 and p = 1) as tp, count(*) filter (label = 0 and p = 1) as fp, count(*) filter (label = 1 and p = 0) as fn from (
        select level, label, {match('l.', 'r.')} as p from truth_ join rec l on l.id = ltable_id join ({copies('r', '[0, 2, 4, 6, 8, 10]')}) r on r.id = rtable_id) group by 1)""", "truth_"),
    "pandas_matcher": sql("select pair_id, cast(decision as double) as match_score, 'ok' as status from dec", "dec"),
}

ORACLES |= {f"{name}_whole": ORACLES[name] for name in ("threshold_candidates", "candidate_topk", "support_set", "attr_saliency")}
