"""The queries of ``pairlens.studies`` in SQL, written down a second time."""

from __future__ import annotations

from .oracles import ATTRS, CTE, FREE, NAME, ORACLES as BASE, PIVOT, SHOWN, TID, WORDS, _all, _cuts, _on, match, sql, text, toks, words

SIDES = [p + a for p in ("ltable_", "rtable_") for a in ATTRS]
_tok = lambda v: f"list_distinct(string_split(lower({v}), ' '))"
_jac = lambda x, y: f"len(list_intersect({x}, {y})) / len(list_distinct(list_concat({x}, {y})))"
_minus = lambda x, y: f"list_filter({x}, lambda t: not list_contains({y}, t))"
_times = lambda x, t: f"len(list_filter({x}, lambda u: u = {t}))"
_chars = lambda a, b: f"list_filter(list_transform(list_concat({_minus(f'list_distinct(string_split({a}, {chr(39)*2}))', f'string_split({b}, {chr(39)*2})')}, {_minus(f'list_distinct(string_split({b}, {chr(39)*2}))', f'string_split({a}, {chr(39)*2})')}), lambda c: lower(c)), lambda c: regexp_matches(c, '{WORDS}'))"


def tfidf(x: str, y: str) -> str:
    weight = lambda own, other: f"coalesce(list_sum(list_transform(list_distinct({own}), lambda t: power({_times(own, 't')} * case when list_contains({other}, t) then 1.0 else ln(1.5) + 1 end, 2))), 0)"
    dot = f"coalesce(list_sum(list_transform(list_distinct({x}), lambda t: {_times(x, 't')} * {_times(y, 't')})), 0)"
    return f"coalesce({dot} / nullif(sqrt({weight(x, y)}) * sqrt({weight(y, x)}), 0), 0.0)"


def tau(a: str, b: str, n: str = "8") -> str:
    """Of lists of eight names."""
    pairs = ", ".join(f"sign(case when {a}[{i}] < {a}[{j}] then 1 when {a}[{i}] > {a}[{j}] then -1 else 0 end * case when {b}[{i}] < {b}[{j}] then 1 when {b}[{i}] > {b}[{j}] then -1 else 0 end)" for i in range(1, 9) for j in range(i + 1, 9))
    return f"2.0 * list_sum([{pairs}]) / 56"


def cosine(x: str, y: str) -> str:
    dot = lambda p, q: f"list_sum(list_transform({p}, lambda t: {_times(q, 't')}))"
    return f"{dot(x, y)} / sqrt(cast({dot(x, x)} * {dot(y, y)} as double))"


_listed = lambda cols: "concat_ws(' ', " + ", ".join(cols) + ")"
_differ = lambda a, b, name: f"case when {a} is distinct from {b} then '{name}' end"
_clean = lambda items: f"list_filter([{', '.join(items)}], lambda x: x is not null)"
_split = lambda v: f"list_filter(list_distinct(string_split(lower({v}), ' ')), lambda x: x <> '')"
_words = lambda v: f"list_distinct(regexp_extract_all(lower({v}), '{WORDS}'))"
_sym = lambda x, y: f"list_concat({_minus(x, y)}, {_minus(y, x)})"
_fid = "array_to_string(altered, '/')"
_ndcg = """case when len(list_filter({0}, lambda x: list_contains({1}, x))) = 0 then 0.0 else list_sum(list_transform(range(1, len({0}) + 1), lambda i: case when list_contains({1}, {0}[i]) then 1 / log2(i + 1) else 0.0 end))
        / list_sum(list_transform(range(1, len(list_filter({0}, lambda x: list_contains({1}, x))) + 1), lambda i: 1 / log2(i + 1))) end"""

CTE |= {
    "self_": (f"select *, cast(3 * len(list_intersect({toks('ltable_')}, {toks('rtable_')})) >= len(list_distinct(list_concat({toks('ltable_')}, {toks('rtable_')}))) as int) as prediction, len(list_distinct(list_concat({toks('ltable_')}, {toks('rtable_')}))) as n_all from rows_", ["rows_"]),
    "ssal": (" union all ".join(f"select pair_id, '{p}{a}' as feature, {_jac(_tok('ltable_' + a), _tok('rtable_' + a))} {'/ 2' if p[0] == 'r' else ''} as saliency from rows_" for p in ("ltable_", "rtable_") for a in ATTRS), ["rows_"]),
    "ranked_s": ("select pair_id, list(feature order by saliency desc, feature) as s from ssal group by 1", ["ssal"]),
    "ranked_t": ("select pair_id, list(feature order by saliency desc, feature) as t from tsal group by 1", ["tsal"]),
    "res": (f"""select 'certa' as explainer, d.pair_id as id, decision as prediction, label, a as names, regexp_extract_all({_listed(f'c.{f}' for f in SIDES)}, '{WORDS}') as w from dec d join ranked_a using (pair_id) left join cf1 c on c.pair_id = d.pair_id
        union all select 'self', pair_id, prediction, label, s, regexp_extract_all({_listed(['rtable_' + a for a in ATTRS] * 2)}, '{WORDS}') from self_ join ranked_s using (pair_id)
        union all select 'zero', pair_id, 0, label, s, regexp_extract_all({_listed(SIDES)}, '{WORDS}') from rows_ join ranked_s using (pair_id)""", ["dec", "ranked_a", "ranked_s", "cf1", "self_", "rows_"]),
    "conc": (f"""select x.explainer as a_explainer, y.explainer as b_explainer, x.id, x.prediction as pred1, y.prediction as pred2, x.label, cast(x.prediction = y.prediction as int) as agree, {tau('x.names', 'y.names')} as kt,
        case when len(x.w) > 0 and len(y.w) > 0 then {cosine('x.w', 'y.w')} end as cos_sim from res x join res y on x.id = y.id and x.explainer < y.explainer""", ["res"]),
    "points": (f"""select explainer, threshold, 2.0 * tp / (2 * tp + fp + fn) as f1 from (select explainer, threshold, count(*) filter (label = 1 and p = 1) as tp, count(*) filter (label = 0 and p = 1) as fp, count(*) filter (label = 1 and p = 0) as fn from (
        select explainer, threshold, label, {match('ltable_', 'rtable_')} as p from (select explainer, threshold, label, {', '.join(f"case when list_contains(r[1:k], '{f}') then '' else list_reduce(list_concat([{f}], list_transform(list_filter(r[1:k], lambda z: starts_with(z, '{f}__')), lambda z: z[{len(f) + 3}:])), lambda u, v: replace(u, v, '')) end as {f}" for f in SIDES)} from rows_ join (
        select 'certa' as explainer, pair_id, a as r from ranked_a union all select 'certa_token', pair_id, t from ranked_t
        union all select 'self', pair_id, list(feature order by case when prediction = 0 then saliency else -saliency end, feature) from ssal join self_ using (pair_id) group by 1, 2) using (pair_id)
        cross join (select t as threshold, greatest(1, cast(floor(t * 9) as int)) as k from (select unnest([0.1, 0.33, 0.5, 0.7, 0.9]) as t)))) group by 1, 2)""", ["rows_", "ranked_a", "ranked_t", "ssal", "self_"]),
    "shares": ("""select coalesce(a.pair_id, t.pair_id) as id, coalesce(a.feature, t.feature) as feature, coalesce(s, 0) as x, coalesce(saliency, 0) as y from (select pair_id, split_part(feature, '__', 1) as feature, sum(saliency) as s from tsal group by 1, 2) t
        full join sal a on a.pair_id = t.pair_id and a.feature = t.feature""", ["tsal", "sal"]),
    "placed": ("""select *, row_number() over (partition by id order by x desc, feature) as px, row_number() over (partition by id order by y desc, feature) as py, count(*) over (partition by id) as n from (
        select id, feature, coalesce(x / nullif(sum(x) over (partition by id), 0), 0) as x, coalesce(y / nullif(sum(y) over (partition by id), 0), 0) as y from shares)""", ["shares"]),
    "cons": (f"""select id, case when has_any then mass else 0 end as mass, case when has_any then {tau('nx', 'ny')} else 0 end as tau, case when has_any then coalesce(pearson, 0) else 0 end as pearson, case when has_any then coalesce(spearman, 0) else 0 end as spearman, case when has_any then overlap else 0 end as overlap, case when has_any then coalesce(cosine, 0) else 0 end as cosine from (
        select id, sum(least(x, y)) as mass, list(feature order by px) as nx, list(feature order by py) as ny, case when var_pop(x) * var_pop(y) * 8 * 8 * 8 * 8 > 1e-15 then covar_pop(x, y) / sqrt(var_pop(x) * var_pop(y)) end as pearson,
        case when var_pop(rx) * var_pop(ry) > 1e-15 then covar_pop(rx, ry) / sqrt(var_pop(rx) * var_pop(ry)) end as spearman, sum((case when greatest(px, py) <= 2 then 1 / 2 else 0 end + case when greatest(px, py) <= 4 then 1 / 4 else 0 end + case when greatest(px, py) <= 6 then 1 / 6 else 0 end) / 3) as overlap,
        sum(x * y) / nullif(sqrt(sum(x * x)) * sqrt(sum(y * y)), 0) as cosine, least(sum(x), sum(y)) > 0 as has_any from (select *, avg(px) over (partition by id, x) as rx, avg(py) over (partition by id, y) as ry from placed) group by 1)""", ["placed"]),
    "cfal": (f"""select pair_id as id, b / len(y) as coverage, coalesce(b / nullif(len(ta), 0), 0) as prec, 2.0 * b / (len(ta) + len(y)) as f1, b / (len(ta) + len(y) - b) as jaccard, {_ndcg.format('top', 'y')} as ndcg, len(y) / 8 as attr_sparsity, len(t) / len(string_split(own, ' ')) as tok_sparsity,
        len(t) / len(string_split(own, ' ')) / (len(y) / 8 + 1e-10) as ger, case when len(p) = 0 and len(q) = 0 then 0.5 else {tfidf('p', 'q')} end as cf_similarity from (
        select *, list_transform(list_sort(list_transform(ta, lambda z: {{'n': -len(list_filter(t, lambda u: split_part(u, '__', 1) = z)), 'a': z}})), lambda z: z.a)[1:3] as top, len(list_intersect(ta, y)) as b from (
        select *, list_distinct(list_transform(t, lambda u: split_part(u, '__', 1))) as ta, {_chars('own', 'mine')} as p, {_chars('own', 'theirs')} as q from (
        select r.pair_id, changed as y, {_listed(f'r.{f}' for f in SIDES)} as own, {_listed(f'c.{f}' for f in SIDES)} as mine, {_listed(['r.rtable_' + a for a in ATTRS] * 2)} as theirs,
        list_concat({', '.join(f"list_transform({_sym(_split('r.ltable_' + a), _split('r.rtable_' + a))}, lambda u: concat('ltable_{a}__', u))" for a in ATTRS)}) as t from rows_ r join cf1 c using (pair_id) join changed using (pair_id))))""", ["rows_", "cf1", "changed"]),
    "ontok": (f"""select r.pair_id, list_concat({', '.join(f"list_transform({_sym(_words('r.' + f), _words('c.' + f))}, lambda u: concat('{f}__', u))" for f in SIDES)}) as t from rows_ r join cf1 c using (pair_id)""", ["rows_", "cf1"]),
    "curve": ("""select explainer, pair_id, k, case when len(c) = 0 then 0 else len(list_intersect(r[1:k], c)) / len(c) end as overlap, mass from (
        select 'certa' as explainer, pair_id, a as r, list_distinct(list_transform(t, lambda u: split_part(u, '__', 1))) as c, (select coalesce(sum(saliency) filter (list_contains(list_transform(t, lambda u: split_part(u, '__', 1)), feature)) / nullif(sum(saliency), 0), 0) from sal s where s.pair_id = o.pair_id) as mass from ontok o join ranked_a using (pair_id)
        union all select 'certa_token', pair_id, ranked_t.t, o.t, (select coalesce(sum(saliency) filter (list_contains(o.t, feature)) / nullif(sum(saliency), 0), 0) from tsal s where s.pair_id = o.pair_id) from ontok o join ranked_t using (pair_id)) cross join (select unnest(range(1, 6)) as k)""", ["ontok", "ranked_a", "ranked_t", "sal", "tsal"]),
    "seen": (f"""select explainer, pair_id, k, decision, {match('n_ltable_', 'n_rtable_')} as new from (select explainer, pair_id, k, decision, {', '.join(f"case when coalesce(list_position(r, '{f}'), 99) > k then {f} when decision = 1 then '' when coalesce(list_position(r, '{o}'), 99) < list_position(r, '{f}') then {f} else {o} end as n_{f}" for f, o in [(p + a, q + a) for p, q in (('ltable_', 'rtable_'), ('rtable_', 'ltable_')) for a in ATTRS])}
        from dec join (select 'certa' as explainer, pair_id, a as r from ranked_a union all select 'self', pair_id, s from ranked_s) using (pair_id) cross join (select unnest(range(6)) as k))""", ["dec", "ranked_a", "ranked_s"]),
    "ftok": ("select distinct pair_id, attribute, concat(attribute, '__', t) as feature from (" + " union all ".join(f"select pair_id, '{f}' as attribute, unnest(string_split({f}, ' ')) as t from rows_" for f in SIDES) + ")", ["rows_"]),
    "pick_s": ("select pair_id, f.feature from ftok f join (select pair_id, feature as attribute from (select *, row_number() over (partition by pair_id, feature[1:1] order by saliency desc, feature) as p from sal) where p <= 2) using (pair_id, attribute)", ["ftok", "sal"]),
    "pick_b": (f"select distinct pair_id, f.feature from ftok f join (select distinct pair_id, unnest(string_split({NAME}, '/')) as attribute from best) using (pair_id, attribute)", ["ftok", "best"]),
    "level_flips": ("select pair_id, side, triangle_id, mask, case when bit_count(mask) > coalesce(level, 99) then 1 else flip end as flip, cast(bit_count(mask) <= coalesce(level, 99) as int) as asked from flip_ join first_full using (triangle_id)", ["flip_", "first_full"]),
    "first_full": ("select triangle_id, min(case when a = 1 then level end) as level from (select triangle_id, bit_count(mask) as level, min(flip) as a from flip_ group by 1, 2) group by 1", ["flip_"]),
    "chosen": ("""select k, pair_id, feature from (select *, row_number() over (partition by k, pair_id order by times desc, feature) as place from (select k, pair_id, feature, count(*) as times from (
        select *, row_number() over (partition by pair_id, draw order by score desc, feature) as p from draws where score > 0) cross join (select unnest(range(2, 9)) as k) where p <= k group by 1, 2, 3)) where place <= k""", ["draws"]),
    "within": ("""select f.pair_id, f.side, f.mask, f.flip, c.k from flip_ f join (select k, pair_id, upper(feature[1:1]) as side, sum(case feature[8:] when 'name' then 1 when 'brand' then 2 when 'type' then 4 else 8 end)::int as bits from chosen group by 1, 2, 3) c
        on c.pair_id = f.pair_id and c.side = f.side and (f.mask & ~c.bits) = 0""", ["flip_", "chosen"]),
    "hsal": (f"""select c.pair_id, c.k, c.feature, coalesce(f / nullif(f_all, 0), 0) as saliency from chosen c join (select pair_id, k, sum(flip) as f_all from within group by 1, 2) using (pair_id, k) left join (select pair_id, k, feature, sum(flip) as f from (
        select pair_id, k, flip, unnest(list_filter([{', '.join(f"case when {_on(i)} then concat(case when side = 'L' then 'ltable_' else 'rtable_' end, '{a}') end" for i, a in enumerate(ATTRS))}], lambda x: x is not null)) as feature from within) group by 1, 2, 3) using (pair_id, k, feature)""", ["chosen", "within"]),
    # the hybrid over what self-explainers say, who agree: pairs that no width before has explained
    "chosen_s": ("""select k, pair_id, feature from (select *, row_number() over (partition by pair_id order by saliency desc, feature) as p from ssal where saliency > 0 and pair_id in (select pair_id from bal)) cross join (select unnest(range(2, 9)) as k) where p <= k""", ["ssal", "bal"]),
    "within_s": ("""select f.pair_id, f.triangle_id, f.side, f.mask, f.flip, c.k from flip_ f join (select k, pair_id, upper(feature[1:1]) as side, sum(case feature[8:] when 'name' then 1 when 'brand' then 2 when 'type' then 4 else 8 end)::int as bits from chosen_s group by 1, 2, 3) c
        on c.pair_id = f.pair_id and c.side = f.side and (f.mask & ~c.bits) = 0""", ["flip_", "chosen_s"]),
    "hsal_s": (f"""select c.pair_id, c.k, c.feature, coalesce(f / nullif(f_all, 0), 0) as saliency from chosen_s c join (select pair_id, k, sum(flip) as f_all from within_s group by 1, 2) using (pair_id, k) left join (select pair_id, k, feature, sum(flip) as f from (
        select pair_id, k, flip, unnest(list_filter([{', '.join(f"case when {_on(i)} then concat(case when side = 'L' then 'ltable_' else 'rtable_' end, '{a}') end" for i, a in enumerate(ATTRS))}], lambda x: x is not null)) as feature from within_s) group by 1, 2, 3) using (pair_id, k, feature)""", ["chosen_s", "within_s"]),
    "width_s": ("select pair_id, coalesce(min(case when s >= 0.1 then k end), 8) as k from (select pair_id, k, sum(saliency) as s from hsal_s group by 1, 2) group by 1", ["hsal_s"]),
    "open_s": ("""select pair_id, k from (select distinct pair_id from bal) left join (select pair_id, k as most from width_s) using (pair_id) cross join (select unnest(range(2, 9)) as k) where k <= coalesce(most, 8)""", ["bal", "width_s"]),
    # the same chain for a matcher that wants a third of the words, without copies
    "dec_m": (CTE["dec"][0].replace("cast(2 * len(", "cast(3 * len("), ["rows_"]),
    "cand_m": (CTE["cand"][0].replace("cast(2 * len(", "cast(3 * len(").replace("from dec m ", "from dec_m m "), ["dec_m", "lsrc_n", "rsrc_n", "dots"]),
    "bal_m": (CTE["bal"][0].replace("from cand_all ", "from cand_m "), ["cand_m"]),
}


def two_step(pick: str) -> str:
    return f"""select pair_id, feature, round(count(*) / f_all, 6) as saliency from (select pair_id, unnest(altered) as feature, f_all from (select *, count(*) over (partition by pair_id) as f_all from (
        select *, max(inside) over (partition by triangle_id) as any_in from (select s.*, cast(list_has_all(coalesce(allowed, []), altered) as int) as inside from steps s left join (select pair_id, list(feature) as allowed from {pick} group by 1) using (pair_id))) where (inside = 1 or any_in = 0) and flip = 1))
        semi join {pick} using (pair_id, feature) group by pair_id, feature, f_all"""


_r = lambda names, n=6: ", ".join(f"round({c}, {n}) + 0 as {c}" for c in names.split())  # noqa: E731  (+ 0: no minus zero)
_avg = lambda names: ", ".join(f"avg({c}) as avg_{c}" for c in names.split())
_CONS, _CFAL = "mass tau pearson spearman overlap cosine", "coverage prec f1 jaccard ndcg attr_sparsity tok_sparsity ger cf_similarity"
_SELF = [("ltable_", "rtable_"), ("rtable_", "ltable_"), ("ltable_", "ltable_"), ("rtable_", "rtable_")]
_ASKED = " union all ".join(f"select {k > 1} as alone, [{_all(lambda a, x=x: x + a)}, {_all(lambda a, y=y: y + a)}] as q, {match(x, y)} as p from rows_" for k, (x, y) in enumerate(_SELF))

ORACLES: dict[str, str] = {
    "explain_any_matcher": BASE["attr_saliency"],
    "explain_with_a_model": sql("select pair_id, side, c_id, ord, decision from bal_m", "bal_m"),
    "self_explain": sql("select pair_id, prediction, feature, round(saliency, 6) as score from self_ join ssal using (pair_id)", "self_", "ssal"),
    "self_explain_turns": sql(f"select pair_id, prediction, 8 as features, array_to_string(list_sort({_clean(_differ('ltable_' + a, 'rtable_' + a, 'ltable_' + a) for a in ATTRS)}), ',') as changed, case when n_all % 5 = 0 then 13 else 11 end as messages from self_", "self_"),
    "few_shot_explain": sql("select pair_id, 0.5 as score, 'x' as changed, 7 as messages from rows_", "rows_"),
    "result_concordance": sql("select id, pred1, pred2, label, agree, round(kt, 6) as kt, round(cos_sim, 6) as cos_sim from conc where a_explainer = 'certa' and b_explainer = 'self'", "conc"),
    "concordance_pairs": sql("select a_explainer, b_explainer, count(*) as n, round(avg(agree), 6) as agreement, round(avg(cast(pred1 = label as int)), 6) as first_right, round(avg(cast(pred2 = label as int)), 6) as second_right, round(avg(kt), 6) as kt, round(avg(cos_sim), 6) as cos_sim from conc group by 1, 2", "conc"),
    "faithfulness_scores": sql("select explainer, threshold, round(f1, 6) as f1 from points", "points"),
    "faithfulness_auc": sql("select explainer, round(sum((threshold - t) * (f1 + f) / 2), 6) as auc from (select *, lag(threshold) over (partition by explainer order by threshold) as t, lag(f1) over (partition by explainer order by threshold) as f from points) group by 1", "points"),
    "cf_metrics_average": sql(f"""select count(*) as n, round(avg(validity), 6) as validity, round(avg(proximity), 6) as proximity, round(avg(1 - proximity / 4), 6) as sparsity, round(avg(diversity), 6) as diversity from (
        select c.pair_id, 1 - abs({match('c.ltable_', 'c.rtable_')} - d.decision) as validity from cf1 c join dec d using (pair_id)) join (select c.pair_id, avg(1 - ({' + '.join(f'cast(c.{f} is not distinct from r.{f} as int)' for f in SIDES)}) / 8) as proximity from cf c join rows_ r using (pair_id) group by 1) using (pair_id)
        join (select pair_id, 1 - same_n / (8 * n * n) as diversity from (select pair_id, sum(c * c) as same_n from ({' union all '.join(f"select pair_id, '{f}' as f, {f} as v, count(*) as c from cf group by 1, 2, 3" for f in SIDES)}) group by 1) join (select pair_id, count(*) as n from cf group by 1) using (pair_id)) using (pair_id)""", "cf1", "cf", "dec", "rows_"),
    "attribute_token_overlap": sql("select pair_id as id, round(len(list_intersect(a[1:3], list_transform(t[1:5], lambda u: split_part(u, '__', 1)))) / 3, 6) as overlap from ranked_a join ranked_t using (pair_id)", "ranked_a", "ranked_t"),
    "saliency_consistency": sql(f"select id, {_r(_CONS, 5)} from cons", "cons"),
    "cf_change_alignment": sql(f"select id, {_r(_CFAL, 5)} from cfal", "cfal"),
    "alignment_by_explainer": sql(f"""select 'rule' as model, 'certa' as explainer, {', '.join(f'round(avg_{c}, 4) as avg_{c}' for c in (_CONS + ' topk_overlap ' + _CFAL).split())} from (
        select {_avg(_CONS)}, avg(len(list_intersect(a[1:3], list_transform(t[1:30], lambda u: split_part(u, '__', 1)))) / 3) as avg_topk_overlap from cons c join ranked_a a on a.pair_id = c.id join ranked_t t on t.pair_id = c.id) cross join (select {_avg(_CFAL)} from cfal join ranked_t on ranked_t.pair_id = id)""", "cons", "cfal", "ranked_a", "ranked_t"),
    "saliency_cf_curve": sql("select explainer, k, count(*) as n, round(avg(overlap), 5) as overlap, round(avg(mass), 5) as mass from curve group by 1, 2", "curve"),
    "attribute_consistency": sql("select explainer, pair_id, k, decision, new from seen", "seen"),
    "consistency_by_explainer": sql("select explainer, round(avg(c), 6) as consistency from (select explainer, pair_id, sum(new) / 6 as c from seen group by 1, 2) group by 1", "seen"),
    "judge_preferences": sql("select case when x > y then 'certa' when y > x then 'self' else 'none' end as pick, count(*) as n from (select length(array_to_string(a[1:2], ' ')) as x, length(array_to_string(s[1:2], ' ')) as y from ranked_a join ranked_s using (pair_id)) group by 1", "ranked_a", "ranked_s"),
    "changed_texts": sql(f"""select pair_id, case when len({_minus("string_split(ltable_name, ' ')", "string_split(rtable_name, ' ')")}) > 0 then concat('-', array_to_string({_minus("string_split(ltable_name, ' ')", "string_split(rtable_name, ' ')")}, ' ')) else concat('+', array_to_string({_minus("string_split(rtable_name, ' ')", "string_split(ltable_name, ' ')")}, ' ')) end as diff,
        concat(ltable_name, ' ', ltable_type) as again, round((2 - {_jac(_tok('ltable_name'), toks('ltable_'))} - {_jac(_tok('ltable_name'), toks('rtable_'))}) / 2, 6) as distance,
        round(case when len(p) = 0 and len(q) = 0 then 0.5 else {tfidf('p', 'q')} end, 6) as cosine from (select *, {_chars('ltable_name', 'rtable_name')} as p, {_chars('ltable_name', 'rtable_type')} as q from rows_)""", "rows_"),
    "pair_copies": sql(f"""select pair_id, side, -row_number() over (partition by pair_id, side order by attribute, n, kind, v) as c_id, {_all(lambda a: f'c_{a}')}, attribute, list_position(['name', 'brand', 'type', 'size'], attribute) as position,
        concat('-', array_to_string({_minus("string_split(case when side = 'L' then " + "case attribute when 'name' then rtable_name when 'brand' then rtable_brand when 'type' then rtable_type else rtable_size end" + " else " + "case attribute when 'name' then ltable_name when 'brand' then ltable_brand when 'type' then ltable_type else ltable_size end" + " end, ' ')", "string_split(v, ' ')")}, ' ')) as diff
        from ({_cuts('L', 'rtable_')} union all {_cuts('R', 'ltable_')})""".replace("from dec where pair_id in (select pair_id from short)", "from dec"), "dec"),
    "two_step_saliency": sql(two_step("pick_s"), "steps", "pick_s"),
    "two_step_sufficient": sql(two_step("pick_b"), "steps", "pick_b"),
    "token_sufficiency": sql(f"select pair_id, {_fid} as altered, round(avg(flip), 6) as sufficiency from steps group by pair_id, steps.altered", "steps"),
    "monotone_traversal": sql("select triangle_id, mask, case when bit_count(mask) > coalesce(level, 99) then 1 else flip end as flip, cast(bit_count(mask) <= coalesce(level, 99) as int) as asked from flip_ join first_full using (triangle_id)", "flip_", "first_full"),
    "full_set_flips": sql(f"select {TID} as triangle_id, 15 as mask, cast(case when side = 'L' then {match('c_', 'rtable_')} else {match('ltable_', 'c_')} end <> decision as int) as flip from bal", "bal"),
    "triangle_lattices": sql(f"""select triangle_id, bit_count(mask) as level, {NAME} as node, flip from flip_ union all select {TID}, -1, concat('pivot: ', {_listed(PIVOT(a) for a in ATTRS)}), null from bal
        union all select {TID}, -1, concat('free: ', {_listed(FREE(a) for a in ATTRS)}), null from bal union all select {TID}, -1, concat('support: ', {_listed('c_' + a for a in ATTRS)}), null from bal""", "flip_", "bal"),
    "saliency_of_some": sql("select pair_id, feature, round(coalesce(f / nullif(f_all, 0), 0), 6) as saliency from (" + " union all ".join(f"select pair_id, '{p}{a}' as feature, sum(case when side = '{s}' and {_on(i)} then flips else 0 end) as f, sum(flips) as f_all from ranks where mask & 2 = 0 and mask <> 13 group by 1" for s, p in (("L", "ltable_"), ("R", "rtable_")) for i, a in enumerate(ATTRS) if a != "brand") + ")", "ranks"),
    "hybrid_adaptive": sql("""select h.pair_id, h.k, h.feature, round(h.saliency, 6) as saliency from hsal h join (select pair_id, coalesce(min(case when s >= 0.1 then k end), max(k)) as k from (select pair_id, k, sum(saliency) as s from hsal group by 1, 2) group by 1) using (pair_id, k)""", "hsal"),
    "hybrid_collected": sql("select pair_id, feature, row_number() over (partition by pair_id order by feature) as place from (select *, row_number() over (partition by pair_id order by saliency desc, feature) as p from ssal where saliency > 0) where p <= 2", "ssal"),
    "hybrid_random": sql("""select pair_id, feature, place from (select pair_id, feature, row_number() over (partition by pair_id order by md5(feature), feature) as place from (select distinct pair_id, feature from (select *, row_number() over (partition by pair_id, draw order by score desc, feature) as p from draws where score > 0) where p <= 2)) where place <= 2""", "draws"),
    "hybrid_token_features": sql("select distinct pair_id, feature from ftok join rows_ using (pair_id) where split_part(feature, '__', 2) = split_part(ltable_name, ' ', 1)", "ftok", "rows_"),
    "feedback_prompts": sql("""select d.pair_id as id, concat('When predicting a pair like ', ltable_name, ' and ', rtable_name, ', pay ', case when decision = label then '' else 'less ' end, 'attention to the following attributes: ', coalesce(names, '')) as told from dec d
        left join (select pair_id, string_agg(feature, ', ' order by saliency desc, feature) as names from sal where saliency > 0 group by 1) using (pair_id)""", "dec", "sal"),
    "answers_read": sql("""select pair_id, case when i = 1 then null else rtable_size end as ltable_size, case when i in (0, 2) then rtable_size else ltable_size end as rtable_size, rtable_size as marked, ltable_size as told, rtable_size as stripped, cast(i in (0, 1) as int) as yes from (select *, ltable_id // 2 % 4 as i from rows_)""", "rows_"),
    "train_and_test": sql("select case when ('0x' || substr(md5(concat('split', ltable_id, '|', rtable_id)), 1, 8))::bigint < 858993459 then 'test' else 'train' end as part, label, count(*) as n from pairs group by 1, 2", "pairs"),
    "robust_f1": sql(f"""select tp, fp, fn, round(2.0 * tp / (2 * tp + fp + fn), 6) as f1 from (select count(*) filter (label = 1 and p = 1) as tp, count(*) filter (label = 0 and p = 1) as fp, count(*) filter (label = 1 and p = 0) as fn from (
        select label, {match('ltable_', 'rtable_')} as p from rows_ union all select label, {match('rtable_', 'ltable_')} from rows_ union all select 1, {match('ltable_', 'ltable_')} from rows_ union all select 1, {match('rtable_', 'rtable_')} from rows_))""", "rows_"),
    "example_pick": sql(f"select pair_id, subset, row_number() over (partition by pair_id order by len(string_split(subset, '/')), subset) as place from (select pair_id, {NAME} as subset from best)", "best"),
    "flaky_matcher": BASE["pandas_matcher"],
    "matcher_counts": sql(f"""select cast(run as integer) as run, count(*) as asked, count(distinct q) as questions, case when run = 1 then (select count(distinct q) from ({_ASKED}) where not alone) else 0 end as known,
        cast(0 as bigint) as failed, cast(sum(p) as bigint) as matches from ({_ASKED}) cross join (select unnest([0, 1]) as run) where run = 1 or not alone group by run""", "rows_"),
    "hybrid_frontier": sql("select h.pair_id, h.k, h.feature, round(h.saliency, 6) as saliency from hsal_s h join width_s using (pair_id, k)", "hsal_s", "width_s"),
    "hybrid_rounds": sql("""select cast(k as integer) as k, pairs, coalesce(asked, 0) as asked from (select k, count(*) as pairs from open_s group by 1)
        left join (select k, count(*) as asked from (select triangle_id, mask, min(k) as k from within_s join open_s using (pair_id, k) group by 1, 2) group by 1) using (k)""", "open_s", "within_s"),
    "level_saliency": sql("select pair_id, feature, round(coalesce(f / nullif(f_all, 0), 0), 6) as saliency from (" + " union all ".join(
        f"select pair_id, '{p}{a}' as feature, sum(case when side = '{s}' and {_on(i)} then flip else 0 end) as f, sum(flip) as f_all from level_flips group by 1" for s, p in (("L", "ltable_"), ("R", "rtable_")) for i, a in enumerate(ATTRS)) + ")", "level_flips"),
    "level_steps": sql("""select triangle_id, path, step, array_to_string(altered, '/') as altered, flip from steps left join (select pair_id, min(step) as most from (select pair_id, step, min(flip) as a from steps group by 1, 2) where a = 1 group by 1) using (pair_id)
        where most is null or step <= most""", "steps"),
    "asked_by_strategy": sql("select 'all' as strategy, count(*) as asked, cast(sum(flip) as bigint) as flips from flip_ union all select 'levels', cast(sum(asked) as bigint), cast(sum(flip) as bigint) from level_flips", "flip_", "level_flips"),
}
