"""DuckDB SQL of the registered retrieval queries."""

from __future__ import annotations

from marlstone.functions.text import BYTES_PER_TOKEN, STOPWORDS
from marlstone.operators.measures import LATENCY_BOUNDS

_CUR = "p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ingested_at DESC, coalesce(score, -9000000000000000000) DESC) AS rn FROM posts) WHERE rn = 1)"


def _quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_WS = r"\s\x{0B}\x{85}\p{Z}"


def _clean(column: str) -> str:
    """HTML to text as a state machine over tokens: what was written (o), whether in a block of code (pre), what end tag is waited for (skip)."""
    token = "regexp_extract_all({}, '<(?:/?[A-Za-z]|[!?])[^>]*>|[^<]+|<')".format(column)
    # a tag's row: its text, whether it closes, its name after a colon; other text has no name
    rows = f"list_transform({token}, lambda t: {{'o': t, 'pre': starts_with(t, '</'), 'skip': CASE WHEN length(t) > 1 AND starts_with(t, '<') THEN ':' || lower(regexp_extract(t, '^</?([A-Za-z0-9]*)', 1)) ELSE '' END}})"
    line = "CASE WHEN ends_with(s.o, chr(10)) THEN s.o ELSE s.o || chr(10) END"

    def put(o: str, pre: str = "s.pre", skip: str = "s.skip") -> str:
        return f"{{'o': {o}, 'pre': {pre}, 'skip': {skip}}}"

    step = f"""CASE WHEN s.skip <> '' THEN CASE WHEN t.skip = s.skip AND t.pre THEN {put('s.o', skip="''")} ELSE s END
    WHEN t.skip = '' THEN {put('s.o || t.o')}
    WHEN t.skip IN (':script', ':style') THEN {put('s.o', skip='t.skip')}
    WHEN t.skip = ':pre' THEN {put(f"{line} || '```' || chr(10)", pre='NOT t.pre')}
    WHEN t.skip = ':code' THEN {put("CASE WHEN s.pre THEN s.o ELSE s.o || '`' END")}
    WHEN t.skip = ':br' THEN {put('s.o || chr(10)')}
    WHEN t.skip IN (':p', ':div', ':ul', ':ol', ':blockquote', ':h1', ':h2', ':h3', ':h4', ':h5', ':h6') THEN {put(f"{line} || CASE WHEN t.pre THEN chr(10) ELSE '' END")}
    WHEN t.skip = ':li' AND NOT t.pre THEN {put(f"{line} || '- '")}
    WHEN t.skip = ':tr' THEN {put(f"CASE WHEN t.pre THEN s.o || ' |' || chr(10) ELSE {line} END")}
    WHEN t.skip IN (':td', ':th') THEN {put("s.o || CASE WHEN t.pre THEN ' ' ELSE '| ' END")}
    WHEN t.skip = ':table' THEN {put(line)} ELSE s END"""
    written = f"list_reduce({rows}, lambda s, t: {step}, {{'o': '', 'pre': false, 'skip': ''}}).o"
    lines = f"list_transform(string_split({written}, chr(10)), lambda l: {{'o': l, 'f': false}})"
    prose = rf"regexp_replace(regexp_replace(l.o, '^[{_WS}]+|[{_WS}]+$', '', 'g'), '[ \t]{{2,}}', ' ', 'g')"
    tidy = rf"""CASE WHEN regexp_matches(l.o, '^[{_WS}]*```') THEN {{'o': s.o || '```' || chr(10), 'f': NOT s.f}}
    WHEN s.f THEN {{'o': s.o || regexp_replace(l.o, '[{_WS}]+$', '') || chr(10), 'f': s.f}} ELSE {{'o': s.o || {prose} || chr(10), 'f': s.f}} END"""
    return rf"CASE WHEN {column} IS NOT NULL THEN regexp_replace(regexp_replace(list_reduce({lines}, lambda s, l: {tidy}, {{'o': '', 'f': false}}).o, '^[{_WS}]+|[{_WS}]+$', '', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g') END"


def _tags(column: str) -> str:
    return f"CASE WHEN {column} LIKE '|%' THEN list_filter(string_split({column}, '|'), lambda x: x <> '') WHEN {column} LIKE '<%' THEN regexp_extract_all({column}, '<([^>]+)>', 1) ELSE [] END"


def _terms(column: str) -> str:
    words = ", ".join(_quote(w) for w in STOPWORDS)
    lower = f"translate({column}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"list_filter(list_transform(regexp_extract_all({lower}, '[a-z0-9][a-z0-9._-]*'), lambda t: regexp_replace(t, '[._-]+$', '')), lambda t: length(t) <= 64 AND NOT list_contains([{words}], t))"


def _hash(column: str) -> str:
    return rf"sha256(trim(regexp_replace({column}, '[\s\p{{Z}}]+', ' ', 'g')))"


def _chunk_id(text: str) -> str:
    return f"substr(sha256(CAST(doc_id AS VARCHAR) || chr(10) || CAST(chunk_index AS VARCHAR) || chr(10) || {_hash(text)}), 1, 32)"


def _tokens(column: str) -> str:
    return f"CAST(ceil(strlen({column}) / {BYTES_PER_TOKEN}.0) AS INTEGER)"


def _bm25(queries: str, docs: str, k: int, out: str) -> str:
    """CTEs that end in `out` (query_id, doc_id, rank, score) over queries (query_id, terms) and docs (doc_id, terms)."""
    return f"""
{out}_q AS (SELECT DISTINCT query_id, unnest(terms) AS term FROM {queries}),
{out}_n AS (SELECT count(*) AS n, greatest(1.0, sum(len(terms)) / count(*)) AS avg_len FROM {docs}),
{out}_t AS (SELECT doc_id, len, term, count(*) AS tf FROM (SELECT doc_id, len(terms) AS len, unnest(terms) AS term FROM {docs}) GROUP BY ALL),
{out}_d AS (SELECT term, count(*) AS df FROM {out}_t GROUP BY term),
{out}_s AS (SELECT query_id, doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * CAST(2.2 AS DOUBLE) / (tf + CAST(1.2 AS DOUBLE) * (0.25 + 0.75 * len / avg_len))) AS s
  FROM {out}_q JOIN {out}_t USING (term) JOIN {out}_d USING (term), {out}_n GROUP BY ALL),
{out} AS (SELECT query_id, doc_id, CAST(rank AS INTEGER) AS rank, round(s, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, doc_id) AS rank FROM {out}_s) WHERE rank <= {k})"""


def _without_self(source: str, k: int, out: str) -> str:
    return f"{out} AS (SELECT query_id, doc_id, score, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS r FROM {source} WHERE query_id <> doc_id) WHERE r <= {k})"


_Q_TITLE = f"qt AS (SELECT query_id, {_terms('query_title')} AS terms FROM golden_pairs)"
_Q_BODY = f"qb AS (SELECT query_id, {_terms(chr(40) + 'CASE WHEN trim(coalesce(query_body, chr(32))) <> chr(32)[1:0] THEN concat_ws(chr(32), query_title, query_body) ELSE query_title END' + chr(41))} AS terms FROM golden_pairs)"
_DOCS = f"d AS (SELECT id AS doc_id, {_terms(chr(40) + 'coalesce(title, ' + _quote('') + ') || chr(32) || regexp_replace(coalesce(body, ' + _quote('') + '), ' + _quote('<[^>]*>') + ', chr(32), ' + _quote('g') + ')' + chr(41))} AS terms FROM p WHERE post_type_id = 1)"
_TITLE = f"WITH {_CUR}, {_Q_TITLE}, {_DOCS}, {_bm25('qt', 'd', 11, 'f')}, {_without_self('f', 10, 'r')}"
_FUSED = f"WITH {_CUR}, {_Q_TITLE}, {_Q_BODY}, {_DOCS}, {_bm25('qt', 'd', 51, 'f')}, {_without_self('f', 50, 'r')}, {_bm25('qb', 'd', 51, 'g')}, {_without_self('g', 50, 's')}"
_EVAL = f"""WITH {_CUR}, {_Q_BODY}, {_DOCS}, {_bm25('qb', 'd', 101, 'f')}, {_without_self('f', 100, 'r')},
m AS (SELECT g.query_id, {', '.join(f'count(*) FILTER (WHERE r.rank <= {k}) / count(*) AS recall_{k}' for k in (1, 5, 10, 50, 100))},
  coalesce(1.0 / min(r.rank), 0.0) AS rr, coalesce(sum(CASE WHEN r.rank <= 10 THEN 1.0 / log2(r.rank + 1.0) END), 0.0) AS ndcg
  FROM golden_pairs g LEFT JOIN r ON r.query_id = g.query_id AND r.doc_id = g.gold_doc_id GROUP BY g.query_id)"""


def _knn(same: str) -> str:
    return f"""WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE len(embedding) = 64),
s AS (SELECT q.vec_id AS query_id, d.vec_id AS doc_id, list_dot_product(q.v, d.v) / (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(d.v, d.v))) AS c FROM e q JOIN e d ON q.vec_id <> d.vec_id {same} WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(c, 9) DESC, doc_id) AS rank FROM s)"""


_ENTRIES = """e AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY tenant) AS rn FROM cache_entries WHERE seq IS NOT NULL) WHERE rn = 1),
v AS (SELECT seq, tenant, CAST(embedding AS DOUBLE[]) AS v FROM e WHERE len(embedding) = 64)"""
_COS = "CASE WHEN list_dot_product(a.v, a.v) = 0 OR list_dot_product(b.v, b.v) = 0 THEN 0 ELSE list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) END"
_KEY = r"sha256(coalesce(tenant, '') || chr(10) || lower(trim(regexp_replace(query, '[\s\p{Z}]+', ' ', 'g'))))"
#: Lookups of a twentieth of the entries against what was inserted before each.
_RULE = r"regexp_matches(lower(query), '(^|[^\p{L}\p{N}_])(20[0-9]{2}|today|yesterday|latest|current|not|don''t|never|without|no|[0-9]+(\.[0-9]+)* ?(gb|mb|tb|ms|%)|port [0-9]+)($|[^\p{L}\p{N}_])')"
_OUTCOMES = f"""WITH {_ENTRIES}, k AS (SELECT seq, {_KEY} AS key, inserted_at FROM e WHERE tenant IS NOT NULL AND query IS NOT NULL),
l AS (SELECT e.*, k.key, {_RULE} AS refuse FROM e JOIN k USING (seq) WHERE seq % 20 = 0),
x AS (SELECT l.seq, arg_max(k.seq, (k.inserted_at, k.seq)) AS exact_seq FROM l JOIN k ON k.key = l.key AND k.inserted_at < l.inserted_at GROUP BY l.seq),
c AS (SELECT a.seq, b.seq AS near_seq, {_COS} AS c FROM v a JOIN v b ON a.tenant = b.tenant JOIN e ea ON ea.seq = a.seq JOIN e eb ON eb.seq = b.seq WHERE a.seq % 20 = 0 AND eb.inserted_at < ea.inserted_at),
n AS (SELECT seq, near_seq, round(round(c, 9), 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY round(c, 9) DESC, near_seq) AS r FROM c) WHERE r = 1 AND round(round(c, 9), 6) >= 0.95),
o AS (SELECT l.seq AS query_id, tenant, CASE WHEN exact_seq IS NOT NULL THEN 'exact' WHEN refuse THEN 'miss' WHEN near_seq IS NOT NULL THEN 'semantic' ELSE 'miss' END AS outcome, exact_seq, near_seq, similarity AS s, exact_seq IS NULL AND refuse AS refused FROM l LEFT JOIN x USING (seq) LEFT JOIN n USING (seq))"""
_STAGES = "st AS (SELECT event_type AS stage, CAST(floor(value * 1000) AS BIGINT) AS micros FROM events)"
_LABELS = f"""WITH {_CUR}, k AS (SELECT id AS link_id, min(post_id) AS post_id, min(related_post_id) AS related_post_id FROM post_links WHERE link_type_id = 3 AND post_id <> related_post_id GROUP BY id),
j AS (SELECT k.*, q.id AS q, g.id AS g, q.title AS query_title, q.body AS query_body, g.title AS gold_title, g.score AS gold_score, EXISTS (SELECT 1 FROM k c WHERE c.post_id = k.related_post_id) AS chained
  FROM k LEFT JOIN p q ON q.id = k.post_id LEFT JOIN p g ON g.id = k.related_post_id),
w AS (SELECT *, CASE WHEN q IS NULL OR g IS NULL THEN 'missing_post' WHEN chained THEN 'chained' WHEN query_title IS NULL OR gold_title IS NULL THEN 'no_title' WHEN coalesce(gold_score, 0) < 1 THEN 'low_score' WHEN strlen(query_title) < 20 THEN 'short_title' END AS why FROM j),
l AS (SELECT *, CASE WHEN why IS NULL AND row_number() OVER (PARTITION BY post_id, why IS NULL ORDER BY link_id) > 1 THEN 'repeated_query' ELSE why END AS reason FROM w)"""
_BUCKET = "CASE " + " ".join(f"WHEN micros / 1e6 <= {b} THEN CAST({b} AS DOUBLE)" for b in LATENCY_BOUNDS) + " ELSE CAST('inf' AS DOUBLE) END"
_HISTOGRAM = f"""WITH {_STAGES}, b AS (SELECT unnest([{', '.join(f'CAST({b} AS DOUBLE)' for b in LATENCY_BOUNDS)}, CAST('inf' AS DOUBLE)]) AS le),
c AS (SELECT stage, {_BUCKET} AS le, count(*) AS n FROM st WHERE micros IS NOT NULL GROUP BY ALL),
h AS (SELECT s.stage, b.le, coalesce(c.n, 0) AS n, CAST(sum(coalesce(c.n, 0)) OVER (PARTITION BY s.stage ORDER BY b.le) AS BIGINT) AS cumulative FROM (SELECT DISTINCT stage FROM c) s, b LEFT JOIN c ON c.stage = s.stage AND c.le = b.le)"""
_LATENCY = f"WITH {_STAGES}, lat AS (SELECT stage, count(micros) AS n, {', '.join(f'round(quantile_disc(micros, {q}) / 1000, 6) AS p{round(q * 100)}_ms' for q in (0.5, 0.95, 0.99))}, round(max(micros) / 1000, 6) AS max_ms, round(avg(micros) / 1000, 6) AS mean_ms FROM st GROUP BY stage)"


def _nearest(source: str, by: str, value: str) -> str:
    picks = ", ".join(f"max(CASE WHEN i = CAST(floor((n - 1) * {q}) AS BIGINT) THEN {value} END) AS p{round(q * 100)}" for q in (0.5, 0.95, 0.99))
    return f"SELECT {by}, max(n) AS n, {picks} FROM (SELECT {by}, {value}, row_number() OVER (PARTITION BY {by} ORDER BY {value}) - 1 AS i, count(*) OVER (PARTITION BY {by}) AS n FROM {source} WHERE {value} IS NOT NULL) GROUP BY {by}"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{_WS}]+|[{_WS}]+$', '', 'g')"


def _toks(x: str) -> str:
    return f"ceil(strlen({x}) / 3.0)"


def _greedy(units: str, joiner: str, limit: int, weaker, name: str) -> str:
    """A list of strings packed under the limit, as a fold: out is done, held goes on. weaker makes the SQL that splits one unit."""
    s, u, w = f"s{name}", f"u{name}", f"w{name}"
    joined = f"CASE WHEN {s}.held IS NULL THEN {u}.held ELSE {s}.held || {joiner} || {u}.held END"
    done = f"CASE WHEN {s}.held IS NULL THEN {s}.out ELSE list_append({s}.out, {s}.held) END"
    split = f"list_transform([{weaker(u + '.held')}], lambda {w}: {{'out': list_concat({done}, {w}[1:len({w}) - 1]), 'held': {w}[len({w})]}})[1]" if weaker else f"{{'out': {done}, 'held': {u}.held}}"
    none = "CAST([] AS VARCHAR[])"
    step = f"CASE WHEN {_toks(joined)} <= {limit} THEN {{'out': {s}.out, 'held': {joined}}} WHEN {_toks(u + '.held')} <= {limit} THEN {{'out': {done}, 'held': {u}.held}} ELSE {split} END"
    rows = f"list_transform({units}, lambda x{name}: {{'out': {none}, 'held': x{name}}})"
    return f"list_transform([list_reduce({rows}, lambda {s}, {u}: {step}, {{'out': {none}, 'held': CAST(NULL AS VARCHAR)}})], lambda r{name}: CASE WHEN r{name}.held IS NULL THEN r{name}.out ELSE list_append(r{name}.out, r{name}.held) END)[1]"


def _hard(x: str, limit: int, name: str) -> str:
    return _greedy(f"regexp_extract_all({x}, '(?s).')", "''", limit, None, name + "h")


def _prose(x: str, limit: int, name: str) -> str:
    def words(y: str) -> str:
        found = _greedy(f"regexp_extract_all({y}, '[^{_WS}]+')", "' '", limit, lambda z: _hard(z, limit, name + "w"), name + "w")
        return f"list_transform([{found}], lambda o{name}: CASE WHEN len(o{name}) = 0 THEN [''] ELSE o{name} END)[1]"

    def sentences(y: str) -> str:
        return _greedy(rf"regexp_extract_all({y}, '(?s:.)[^.!?\n]*(?:[.!?\n]|\z)')", "''", limit, words, name + "t")

    return f"list_filter({_greedy(f'string_split({x}, chr(10) || chr(10))', 'chr(10) || chr(10)', limit, sentences, name + 'p')}, lambda k{name}: {_strip('k' + name)} <> '')"


def _code(x: str, limit: int, name: str) -> str:
    room = max(16, limit - 8)
    lines = f"list_filter(string_split({x}, chr(10)), lambda l{name}: {_strip('l' + name)} <> '```')"
    parts = _greedy(lines, "chr(10)", room, lambda z: _hard(z, room, name + "c"), name + "c")
    return f"list_transform(list_filter({parts}, lambda k{name}: {_strip('k' + name)} <> ''), lambda f{name}: '```' || chr(10) || f{name} || chr(10) || '```')"


def _tail(x: str, limit: int) -> str:
    def kept(units: str, joiner: str) -> str:
        longer = f"CASE WHEN ts.k <> '' THEN tu.k || {joiner} || ts.k ELSE tu.k END"
        rows = f"list_transform(list_reverse({units}), lambda tx: {{'k': tx, 'stop': false}})"
        return _strip(f"list_reduce({rows}, lambda ts, tu: CASE WHEN ts.stop OR {_toks(longer)} > {limit} THEN {{'k': ts.k, 'stop': true}} ELSE {{'k': {longer}, 'stop': false}} END, {{'k': '', 'stop': false}}).k")

    by_line, by_word = kept(f"string_split({x}, chr(10))", "chr(10)"), kept(f"regexp_extract_all({x}, '[^{_WS}]+')", "' '")
    return f"CASE WHEN {by_line} <> '' THEN {by_line} ELSE {by_word} END"


def _chunked(text: str, target: int = 512, overlap: int = 51) -> str:
    """The chunks of a text, a list of (t, k, s): text, kind and whether code was split, as folds over lines, units and segments."""
    limit = max(target - overlap, target // 2)
    piece = "STRUCT(t VARCHAR, k VARCHAR, s BOOLEAN)[]"
    cur = "CASE WHEN gs.cur IS NULL THEN gu.cur ELSE gs.cur || chr(10) || gu.cur END"
    some = f"regexp_matches(coalesce(gs.cur, ''), '[^{_WS}]')"
    segment = f"""CASE WHEN {_strip('gu.cur')} = '```' AND gs.code THEN {{'segs': list_append(gs.segs, {{'t': {cur}, 'k': 'code', 's': false}}), 'cur': CAST(NULL AS VARCHAR), 'code': false}}
    WHEN {_strip('gu.cur')} = '```' THEN {{'segs': CASE WHEN {some} THEN list_append(gs.segs, {{'t': gs.cur, 'k': 'prose', 's': false}}) ELSE gs.segs END, 'cur': gu.cur, 'code': true}}
    ELSE {{'segs': gs.segs, 'cur': {cur}, 'code': gs.code}} END"""
    lines = f"list_transform(string_split({text}, chr(10)), lambda gl: {{'segs': CAST([] AS {piece}), 'cur': gl, 'code': false}})"
    folded = f"list_reduce({lines}, lambda gs, gu: {segment}, {{'segs': CAST([] AS {piece}), 'cur': CAST(NULL AS VARCHAR), 'code': false}})"
    segments = f"list_transform([{folded}], lambda gr: CASE WHEN regexp_matches(coalesce(gr.cur, ''), '[^{_WS}]') THEN list_append(gr.segs, {{'t': gr.cur, 'k': CASE WHEN gr.code THEN 'code' ELSE 'prose' END, 's': false}}) ELSE gr.segs END)[1]"
    units = f"""flatten(list_transform({segments}, lambda sg: CASE WHEN {_toks('sg.t')} <= {limit} THEN [sg]
    WHEN sg.k = 'code' THEN list_transform({_code('sg.t', limit, 'a')}, lambda sc: {{'t': sc, 'k': 'code', 's': true}}) ELSE list_transform({_prose('sg.t', limit, 'b')}, lambda sp: {{'t': sp, 'k': 'prose', 's': false}}) END))"""
    kind = "CASE WHEN ps.code THEN 'code' ELSE 'prose' END"
    body = _strip("ps.held")

    def one(state: str) -> str:
        b = body.replace("ps.", state)
        k = kind.replace("ps.", state)
        parts = f"CASE WHEN {state}code THEN {_code('fb', target, 'c')} ELSE {_prose('fb', target, 'd')} END"
        return f"list_transform([{b}], lambda fb: list_concat({state}out, CASE WHEN fb = '' THEN CAST([] AS {piece}) WHEN {_toks('fb')} <= {target} THEN [{{'t': fb, 'k': {k}, 's': false}}] ELSE list_transform({parts}, lambda fx: {{'t': {_strip('fx')}, 'k': {k}, 's': false}}) END))[1]"

    u = "pu.out[1]"
    carry = f"CASE WHEN {u}.k = 'code' OR ps.code THEN '' ELSE {_tail('ps.held', overlap)} END"
    step = f"""CASE WHEN {u}.s THEN {{'out': list_append({one('ps.')}, {{'t': {_strip(u + '.t')}, 'k': {u}.k, 's': true}}), 'held': '', 'code': false}}
    WHEN {body} <> '' AND {_toks(f'ps.held || {u}.t')} > {target} THEN {{'out': {one('ps.')}, 'held': list_transform([{carry}], lambda cy: CASE WHEN cy <> '' THEN cy || chr(10) ELSE '' END)[1] || {u}.t || chr(10), 'code': {u}.k = 'code'}}
    ELSE {{'out': ps.out, 'held': ps.held || {u}.t || chr(10), 'code': ps.code OR {u}.k = 'code'}} END"""
    rows = f"list_transform({units}, lambda un: {{'out': [un], 'held': '', 'code': false}})"
    packed = f"list_reduce({rows}, lambda ps, pu: {step}, {{'out': CAST([] AS {piece}), 'held': '', 'code': false}})"
    return f"list_transform([{packed}], lambda pr: {one('pr.')})[1]"


_FULL = "coalesce(title, '') || chr(10) || chr(10) || coalesce(body, '') || coalesce(array_to_string(list_transform(answers, lambda a, i: chr(10) || chr(10) || 'Answer ' || i || ':' || chr(10) || coalesce(a, '')), ''), '')"
_CHUNKED = f"""q AS (SELECT doc_id, any_value(title) AS title, any_value(tags) AS tags, full_text FROM (SELECT *, {_FULL} AS full_text FROM qa_docs) GROUP BY doc_id, full_text),
cl AS (SELECT doc_id, title, tags, {_chunked('full_text')} AS l FROM q), cu AS (SELECT doc_id, title, tags, len(l) AS n, unnest(l) AS c, unnest(range(len(l))) AS i FROM cl),
c AS (SELECT doc_id, title, tags, CAST(i AS INTEGER) AS chunk_index, CAST(n AS INTEGER) AS chunk_count, c.t AS display_text, c.k AS element_type, c.s AS split_code, {_tokens('c.t')} AS token_count FROM cu)"""

_CHUNK_STATS = """, d AS (SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE element_type = 'code') AS code, sum(token_count) AS tokens, max(token_count) AS most, count(*) FILTER (WHERE token_count > 512) AS o, count(*) FILTER (WHERE token_count < 50) AS u FROM c GROUP BY doc_id),
tk AS (SELECT token_count AS v, row_number() OVER (ORDER BY token_count) - 1 AS i, count(*) OVER () AS n FROM c WHERE token_count IS NOT NULL), dk AS (SELECT n AS v, row_number() OVER (ORDER BY n) - 1 AS i, count(*) OVER () AS n FROM d)
SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_chunks, max(n) AS most_per_doc, CAST(sum(code) AS BIGINT) AS n_code, CAST(sum(tokens) AS BIGINT) AS n_tokens, max(most) AS most_tokens, CAST(sum(o) AS BIGINT) AS n_over, CAST(sum(u) AS BIGINT) AS n_under,
round(100.0 * sum(code) / sum(n), 3) AS pct_code, round(100.0 * sum(o) / sum(n), 3) AS pct_over, round(100.0 * sum(u) / sum(n), 3) AS pct_under, CAST(sum(n) * 1536 AS BIGINT) AS float_bytes, CAST(sum(n) * 384 AS BIGINT) AS byte_bytes, CAST(sum(n) * 128 AS BIGINT) AS graph_bytes, CAST(sum(n) * 512 AS BIGINT) AS resident_bytes,
""" + ", ".join(f"(SELECT max(v) FROM {t} WHERE i = CAST(floor((n - 1) * {q}) AS BIGINT)) AS p{round(q * 100)}_{name}" for t, name in (("tk", "tokens"), ("dk", "per_doc")) for q in (0.5, 0.95, 0.99)) + " FROM d"

_CHUNKS = f"""ch AS (SELECT raw_id, doc_id, text FROM (SELECT *, row_number() OVER (PARTITION BY raw_id ORDER BY doc_id DESC, text DESC) AS rn FROM raw_chunks) WHERE rn = 1), d AS (SELECT raw_id AS doc_id, {_terms('text')} AS terms FROM ch)"""


def _fetched(k: int) -> str:
    """CTEs that end in m (query_id, chunk_id, doc_id, text, rank) and z, one chunk a document with doc_rank."""
    return f"""WITH {_Q_TITLE}, {_CHUNKS}, {_bm25('qt', 'd', k, 'f')}, m AS (SELECT f.query_id, f.doc_id AS chunk_id, ch.doc_id, ch.text, f.rank FROM f JOIN ch ON ch.raw_id = f.doc_id),
fd AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY rank, chunk_id) AS i FROM m), z AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank, chunk_id) AS doc_rank FROM fd WHERE i = 1)"""


def _rendered(texts: str) -> str:
    return f"'<<<UNTRUSTED SOURCES' || chr(10) || {texts} || chr(10) || 'UNTRUSTED SOURCES>>>'"


_CALLS = """ca AS (SELECT user_id || '-' || strftime(ts, '%Y%m%d') AS request, CASE WHEN event_id % 3 = 0 THEN 'large' ELSE 'small' END AS model, CASE WHEN event_id % 2 = 0 THEN '1h' ELSE '5m' END AS ttl, event_id % 1000 AS ti, event_id % 100 AS tw, event_id % 7 * 100 AS cw, event_id % 5 * 200 AS cr FROM events)"""
_RECORDS = """re AS (SELECT event_id, ts, 't' || (user_id % 3) AS tenant, CAST(event_id % 3 AS INTEGER) AS route_tier, CASE event_id % 5 WHEN 0 THEN 'exact_hit' WHEN 1 THEN 'semantic_hit' ELSE 'miss' END AS cache_outcome, event_id % 11 = 0 AS degraded, round(value / 1000, 6) AS usd,
CAST(floor(value * 1000) AS BIGINT) AS micros, event_type, event_id % 50 * 1000 AS search, event_id % 1000 AS ti, event_id % 100 AS tw, event_id % 2 * 50 AS cr FROM events)"""
_COST_BUCKETS = [0.0001, 0.0005, 0.001, 0.0025, 0.005, 0.01, 0.02, 0.03, 0.04, 0.05, 0.06, 0.07, 0.08, 0.1, 0.25, 0.5, 1.0]


def _buckets(source: str, by: str, value: str, bounds: list[float]) -> str:
    """Rows (by, le, n, cumulative) of a histogram."""
    doubles = ", ".join(f"CAST({b} AS DOUBLE)" for b in bounds)
    own = " AND ".join(f"hc.{c.strip()} IS NOT DISTINCT FROM hs.{c.strip()}" for c in by.split(","))
    listed = ", ".join(f"hs.{c.strip()}" for c in by.split(","))
    return f"""SELECT {listed}, hb.le, count(hc.v) AS n, CAST(sum(count(hc.v)) OVER (PARTITION BY {listed} ORDER BY hb.le) AS BIGINT) AS cumulative
FROM (SELECT DISTINCT {by} FROM {source}) hs, (SELECT unnest([{doubles}, CAST('inf' AS DOUBLE)]) AS le, unnest([CAST('-inf' AS DOUBLE), {doubles}]) AS lo) hb
LEFT JOIN (SELECT {by}, {value} AS v FROM {source} WHERE {value} IS NOT NULL) hc ON {own} AND hc.v <= hb.le AND hc.v > hb.lo GROUP BY {listed}, hb.le"""


_ROUTED = r"""ro AS (SELECT query_id, query_title, CASE WHEN regexp_matches(lower(query_title), '(^|[^\p{L}\p{N}_])(hi|thanks)($|[^\p{L}\p{N}_])') THEN 0 WHEN regexp_matches(lower(query_title), '(^|[^\p{L}\p{N}_])(versus|compare|against)($|[^\p{L}\p{N}_])') OR coalesce(len(list_filter(string_split_regex(query_title, '\s+'), lambda x: x <> '')), 0) > 14 THEN 2 ELSE 1 END AS tier FROM golden_pairs)"""
_MODEL = "CASE tier WHEN 1 THEN 'small' WHEN 2 THEN 'large' END"
_FIRST = rf"regexp_replace(substr(coalesce(text, ''), 1, 300), '^[{_WS}]+|[{_WS}]+$', '', 'g')"
_TITLE_TEXT = r"trim(regexp_replace(title, '[\x00-\x1f\x7f-\x9f\x{fdd0}-\x{fdef}\x{fffe}\x{ffff}]', ' ', 'g'))"

ORACLE = {
    "corpus_scan_stats": f"SELECT count(*) AS n_rows, count(*) FILTER (WHERE post_type_id = 1) AS questions, count(*) FILTER (WHERE post_type_id = 2) AS answers, count(*) FILTER (WHERE NOT coalesce(post_type_id IN (1, 2), false)) AS others, count(accepted_answer_id) AS accepted, count(*) FILTER (WHERE contains(body, '<code')) AS with_code, CAST(sum(strlen(body)) AS BIGINT) AS body_bytes, (SELECT count(DISTINCT tag) FROM (SELECT unnest({_tags('tags')}) AS tag FROM posts)) AS distinct_tags FROM posts",
    "tag_histogram": f"WITH {_CUR} SELECT tag, count(*) AS n FROM (SELECT unnest({_tags('tags')}) AS tag FROM p) GROUP BY tag",
    "tag_histogram_topn": f"WITH {_CUR} SELECT tag, count(*) AS n FROM (SELECT unnest({_tags('tags')}) AS tag FROM p) GROUP BY tag ORDER BY n DESC, tag LIMIT 12",
    "gold_tag_distribution": "SELECT tag, count(*) AS n FROM (SELECT unnest(gold_tags) AS tag FROM golden_pairs) GROUP BY tag",
    "parse_tags": f"WITH {_CUR}, t AS (SELECT id, {_tags('tags')} AS t FROM p) SELECT id, CAST(pos AS INTEGER) AS pos, t[pos + 1] AS tag FROM (SELECT id, t, unnest(range(len(t))) AS pos FROM t)",
    "html_clean": f"WITH {_CUR} SELECT id, {_clean('body')} AS text FROM p",
    "text_profile": f"SELECT doc_id, {_tokens('text')} AS tokens, contains(text, '```') AS has_code, {_hash('text')} AS content_hash, substr(text, 1, 80) AS excerpt FROM documents",
    "duplicate_hashes": f"SELECT content_hash, count(*) AS n, min(doc_id) AS first_doc FROM (SELECT doc_id, {_hash('text')} AS content_hash FROM documents WHERE text IS NOT NULL) GROUP BY content_hash HAVING count(*) > 1",
    "document_text": f"SELECT DISTINCT doc_id, {_tokens('(coalesce(title, ' + _quote('') + ') || chr(10) || chr(10) || coalesce(body, ' + _quote('') + ') || coalesce(array_to_string(list_transform(answers, lambda a, i: chr(10) || chr(10) || ' + _quote('Answer ') + ' || i || ' + _quote(':') + ' || chr(10) || coalesce(a, ' + _quote('') + ')), ' + _quote('') + '), ' + _quote('') + '))')} AS full_tokens, CASE WHEN len(tags) > 0 THEN coalesce(title, '') || ' [' || array_to_string(tags, ', ') || ']' || chr(10) ELSE coalesce(title, '') || chr(10) END AS prefix FROM qa_docs",
    "raw_chunk_stats": f"WITH c AS (SELECT raw_id, any_value(doc_id) AS doc_id, any_value(element_type) AS element_type, {_tokens('any_value(text)')} AS token_count FROM raw_chunks GROUP BY raw_id) {_CHUNK_STATS}",
    "chunk_token_percentiles": f"WITH c AS (SELECT DISTINCT raw_id, element_type, text FROM raw_chunks), t AS (SELECT element_type, {_tokens('text')} AS tokens FROM c) {_nearest('t', 'element_type', 'tokens')}",
    "changed_chunks": f"WITH r AS (SELECT DISTINCT raw_id, doc_id, chunk_index, text FROM raw_chunks), n AS (SELECT raw_id, doc_id, chunk_index, CASE raw_id % 7 WHEN 0 THEN text || ' (edited)' WHEN 1 THEN '  ' || text ELSE text END AS text FROM r), o AS (SELECT {_chunk_id('text')} AS chunk_id FROM r WHERE text IS NOT NULL) SELECT raw_id, {_chunk_id('text')} AS chunk_id FROM n WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.chunk_id = {_chunk_id('n.text')})",
    "answers_top3": f"WITH {_CUR} SELECT parent_id, answer_id, CAST(r AS INTEGER) AS rank_no FROM (SELECT parent_id, id AS answer_id, row_number() OVER (PARTITION BY parent_id ORDER BY coalesce(score, 0) DESC, id) AS r FROM p WHERE post_type_id = 2 AND parent_id IS NOT NULL) WHERE r <= 3",
    "assembled_documents": f"WITH {_CUR}, a AS (SELECT parent_id, count(*) AS n, string_agg({_clean('body')}, chr(10) ORDER BY r) AS t FROM (SELECT parent_id, body, row_number() OVER (PARTITION BY parent_id ORDER BY coalesce(score, 0) DESC, id) AS r FROM p WHERE post_type_id = 2 AND parent_id IS NOT NULL) WHERE r <= 3 GROUP BY parent_id) SELECT id AS doc_id, title, CAST(coalesce(n, 0) AS INTEGER) AS n_answers, CAST(strlen(coalesce(t, '')) AS INTEGER) AS answer_bytes, array_to_string({_tags('tags')}, ',') AS tag_list, score, substr(creation_date, 1, 10) AS effective_date, 'qa://posts/q/' || id AS source_uri FROM p LEFT JOIN a ON a.parent_id = p.id WHERE post_type_id = 1",
    "bm25_stats": f"SELECT count(*) AS doc_count, CAST(sum(len(t)) AS BIGINT) AS total_len, round(greatest(1.0, sum(len(t)) / count(*)), 6) AS avg_len FROM (SELECT {_terms('text')} AS t FROM documents WHERE text IS NOT NULL)",
    "bm25_idf": f"WITH t AS (SELECT doc_id, {_terms('text')} AS t FROM documents WHERE text IS NOT NULL), d AS (SELECT term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest(t) AS term FROM t) GROUP BY term) SELECT term, df, round(ln(1 + ((SELECT count(*) FROM t) - df + 0.5) / (df + 0.5)), 6) AS idf FROM d",
    "bm25_doc_vector": f"WITH t AS (SELECT doc_id, {_terms('text')} AS t FROM documents WHERE text IS NOT NULL), f AS (SELECT doc_id, len, term, count(*) AS tf FROM (SELECT doc_id, len(t) AS len, unnest(t) AS term FROM t) GROUP BY ALL) SELECT doc_id, term, tf, round(tf * CAST(2.2 AS DOUBLE) / (tf + CAST(1.2 AS DOUBLE) * (0.25 + 0.75 * len / (SELECT greatest(1.0, sum(len(t)) / count(*)) FROM t))), 6) AS weight FROM f",
    "bm25_search": _TITLE + " SELECT query_id, doc_id, rank, score FROM r",
    "rrf_fusion": _FUSED + ", u AS (SELECT query_id, doc_id, rank, 'title' AS retriever FROM r UNION ALL SELECT query_id, doc_id, rank, 'body' FROM s), x AS (SELECT query_id, doc_id, sum(1.0 / (60 + rank)) AS score, string_agg(DISTINCT retriever, '+' ORDER BY retriever) AS retrievers FROM u GROUP BY ALL), y AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM x) SELECT query_id, doc_id, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score, retrievers FROM y WHERE rank <= 10",
    "dense_knn": _knn("") + " SELECT query_id, doc_id, CAST(rank AS INTEGER) AS rank, round(round(c, 9), 6) AS score FROM r WHERE rank <= 10",
    "dense_knn_filtered": _knn("AND q.label = d.label") + " SELECT query_id, doc_id, CAST(rank AS INTEGER) AS rank, round(round(c, 9), 6) AS score FROM r WHERE rank <= 10",
    "hybrid_search": f"WITH {_ENTRIES}, qs AS (SELECT seq AS query_id, {_terms('query')} AS terms FROM e WHERE seq % 20 = 0), ds AS (SELECT seq AS doc_id, {_terms('query')} AS terms FROM e), {_bm25('qs', 'ds', 51, 'f')}, {_without_self('f', 50, 's')}, c AS (SELECT a.seq AS query_id, b.seq AS doc_id, {_COS} AS c FROM v a JOIN v b ON a.seq <> b.seq WHERE a.seq % 20 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(c, 9) DESC, doc_id) AS rank FROM c), u AS (SELECT query_id, doc_id, rank, 'dense' AS retriever FROM r WHERE rank <= 50 UNION ALL SELECT query_id, doc_id, rank, 'sparse' FROM s), x AS (SELECT query_id, doc_id, sum(1.0 / (60 + rank)) AS score, string_agg(DISTINCT retriever, '+' ORDER BY retriever) AS retrievers FROM u GROUP BY ALL), y AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM x) SELECT query_id, doc_id, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score, retrievers FROM y WHERE rank <= 10",
    "dedupe_by_document": _fetched(50) + " SELECT query_id, doc_id, chunk_id, CAST(doc_rank AS INTEGER) AS doc_rank FROM z WHERE doc_rank <= 10",
    "golden_build": _LABELS + " SELECT post_id AS query_id, related_post_id AS gold_doc_id, query_title, substr(query_body, 1, 500) AS query_body, gold_title, gold_score FROM l WHERE reason IS NULL",
    "golden_build_stats": _LABELS + " SELECT coalesce(reason, 'kept') AS outcome, count(*) AS n FROM l GROUP BY ALL",
    "golden_split": "SELECT query_id, CASE WHEN CAST('0x' || substr(sha256(CAST(query_id AS VARCHAR)), 1, 8) AS BIGINT) < CAST(floor(0.2 * 4294967296) AS BIGINT) THEN 'test' ELSE 'train' END AS split FROM golden_pairs",
    "index_composition": f"WITH {_CUR}, q AS (SELECT id FROM p WHERE post_type_id = 1), g AS (SELECT id FROM q WHERE id IN (SELECT gold_doc_id FROM golden_pairs)) SELECT id, 'gold' AS role FROM g UNION ALL SELECT id, 'distractor' FROM (SELECT id, row_number() OVER (ORDER BY id) AS r FROM q WHERE id NOT IN (SELECT id FROM g)) WHERE r <= greatest(0, 2 * (SELECT count(DISTINCT gold_doc_id) FROM golden_pairs) - (SELECT count(*) FROM g))",
    "eval_queries": _EVAL + " SELECT query_id, round(recall_1, 6) AS recall_1, round(recall_5, 6) AS recall_5, round(recall_10, 6) AS recall_10, round(recall_50, 6) AS recall_50, round(recall_100, 6) AS recall_100, round(rr, 6) AS rr, round(ndcg, 6) AS ndcg FROM m",
    "eval_report": _EVAL + " SELECT count(*) AS n_queries, round(avg(recall_1), 6) AS recall_1, round(avg(recall_5), 6) AS recall_5, round(avg(recall_10), 6) AS recall_10, round(avg(recall_50), 6) AS recall_50, round(avg(recall_100), 6) AS recall_100, round(avg(rr), 6) AS mrr, round(avg(ndcg), 6) AS ndcg, count(*) FILTER (WHERE rr = 0) AS misses FROM m",
    "eval_misses": _EVAL + " SELECT query_id FROM m WHERE rr = 0",
    "eval_by_label": _knn("") + """, t AS (SELECT query_id, doc_id, rank FROM r WHERE rank <= 10),
g AS (SELECT a.vec_id AS query_id, b.vec_id AS doc_id, CASE WHEN abs(b.vec_id - a.vec_id) < 100 THEN 3.0 ELSE 1.0 END AS gain FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0),
i AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY gain DESC, doc_id) AS ir FROM g),
x AS (SELECT i.*, t.rank FROM i LEFT JOIN t USING (query_id, doc_id))
SELECT query_id, round(count(*) FILTER (WHERE rank <= 1) / count(*), 6) AS recall_1, round(count(*) FILTER (WHERE rank <= 5) / count(*), 6) AS recall_5, round(count(*) FILTER (WHERE rank <= 10) / count(*), 6) AS recall_10, round(coalesce(1.0 / min(rank), 0.0), 6) AS rr,
round(least(1.0, coalesce(sum(CASE WHEN rank <= 10 THEN gain / log2(rank + 1.0) END), 0.0) / sum(CASE WHEN ir <= 10 THEN gain / log2(ir + 1.0) END)), 6) AS ndcg FROM x GROUP BY query_id""",
    "vector_similarity": "WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings) SELECT a.vec_id, round(" + _COS + ", 6) AS similarity FROM v a JOIN v b ON b.vec_id = a.vec_id + 1",
    "exact_cache": f"WITH {_ENTRIES}, k AS (SELECT {_KEY} AS key, arg_max(answer, seq) FILTER (WHERE true) AS a0, max(seq) AS seq FROM e WHERE tenant IS NOT NULL AND query IS NOT NULL GROUP BY ALL), u AS (SELECT seq AS query_id, {_KEY.replace('query,', 'upper(query),')} AS key FROM e WHERE seq % 20 = 0) SELECT u.query_id, k.seq AS hit_seq, e.answer FROM u LEFT JOIN k USING (key) LEFT JOIN e ON e.seq = k.seq",
    "semantic_cache": f"WITH {_ENTRIES}, a AS (SELECT seq, tenant, list_transform(e2, lambda x, i: CASE WHEN (i - 1) % 3 = 0 THEN CAST(CAST(x * CAST(1.5 AS FLOAT) AS FLOAT) AS DOUBLE) ELSE CAST(x AS DOUBLE) END) AS v FROM (SELECT seq, tenant, CAST(embedding AS FLOAT[]) AS e2 FROM e WHERE len(embedding) = 64 AND seq % 20 = 0)), c AS (SELECT a.seq + 1 AS query_id, b.seq AS hit_seq, {_COS} AS c FROM a JOIN v b ON a.tenant = b.tenant), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(c, 9) DESC, hit_seq) AS rank FROM c) SELECT query_id, hit_seq, round(round(c, 9), 6) AS similarity FROM r WHERE rank = 1 AND round(round(c, 9), 6) >= 0.95",
    "cache_as_of": f"WITH {_ENTRIES} SELECT seq, lag(seq) OVER (PARTITION BY {_KEY} ORDER BY inserted_at, seq) AS hit_seq FROM e WHERE tenant IS NOT NULL AND query IS NOT NULL",
    "cache_stats": _OUTCOMES + " SELECT tenant, count(*) AS lookups, count(*) FILTER (WHERE outcome = 'exact') AS exact, count(*) FILTER (WHERE outcome = 'semantic') AS semantic, count(*) FILTER (WHERE outcome = 'miss') AS misses, count(*) FILTER (WHERE refused) AS refused, round(count(*) FILTER (WHERE outcome <> 'miss') / count(*), 6) AS hit_rate FROM o GROUP BY tenant",
    "citations": r"SELECT DISTINCT doc_id, CAST(x AS INTEGER) AS source FROM (SELECT doc_id, unnest(regexp_extract_all(regexp_replace(text, '\b(\d{1,2})\b', '[\1]', 'g'), '\[([0-9]{1,9})\]', 1)) AS x FROM documents WHERE text IS NOT NULL) WHERE CAST(x AS INTEGER) BETWEEN 1 AND 12",
    "latency_percentiles": _LATENCY + " SELECT * FROM lat",
    "nearest_rank_pct": f"WITH {_STAGES} {_nearest('st', 'stage', 'micros')}",
    "latency_histogram": _HISTOGRAM + " SELECT * FROM h",
    "histogram_quantile": _HISTOGRAM + ", w AS (SELECT *, max(cumulative) OVER (PARTITION BY stage) * 0.95 AS t, coalesce(lag(cumulative) OVER (PARTITION BY stage ORDER BY le), 0) AS below, coalesce(lag(le) OVER (PARTITION BY stage ORDER BY le), 0.0) AS lo FROM h) SELECT stage, round(CASE WHEN isinf(le) THEN lo ELSE lo + (le - lo) * (t - below) / (cumulative - below) END, 6) AS value FROM w WHERE cumulative >= t AND below < t",
    "rate_windows": "WITH x AS (SELECT event_type, time_bucket(INTERVAL '6 hours', ts) - i * INTERVAL '6 hours' AS window_start FROM events, (SELECT unnest(range(4)) AS i)) SELECT window_start, event_type, count(*) AS n, round(count(*) / 86400.0, 6) AS per_second FROM x WHERE event_type IS NOT NULL OR true GROUP BY ALL",
    "load_report": "WITH x AS (SELECT event_type, (event_id % 13) * 5000 AS delay, CASE WHEN event_id % 50 <> 0 THEN CAST(floor(value * 1000) AS BIGINT) END AS good FROM events) SELECT event_type, count(*) AS sent, round(quantile_disc(good + delay, 0.95) / 1000, 6) AS corrected_p95_ms, round(quantile_disc(good, 0.95) / 1000, 6) AS naive_p95_ms, round(max(delay) / 1000, 6) AS max_delay_ms, max(delay) > 50000 AS fell_behind, round((SELECT count(*) FROM events e WHERE e.event_id % 50 = 0 AND e.event_type IS NOT DISTINCT FROM x.event_type) / count(*), 6) AS error_rate FROM x GROUP BY event_type",
    "slo_report": _LATENCY + " SELECT stage AS name, 150.0::DOUBLE AS budget, p95_ms AS measured, true AS lower_is_better, p95_ms <= 150 AS passed, round((150 - p95_ms) / 150, 6) AS headroom, p95_ms <= 150 AND round((150 - p95_ms) / 150, 6) < 0.1 AS tight FROM lat",
    "running_budget": "WITH g AS (SELECT l_orderkey, l_linenumber, sum(CAST(l_extendedprice AS DOUBLE)) AS amount FROM lineitem GROUP BY ALL), x AS (SELECT *, coalesce(sum(amount) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM g) SELECT l_orderkey, l_linenumber, round(b, 2) AS spent_before, round(greatest(60000 - b, 0), 2) AS remaining, CASE WHEN 60000 - b <= 0 THEN 'exhausted' WHEN amount > 60000 - b THEN 'would_exceed' ELSE 'ok' END AS status FROM x",
    "cost_by_type": f"WITH {_CUR}, x AS (SELECT CASE WHEN post_type_id = 1 THEN 'large' ELSE 'small' END AS model, {_tokens('body')} AS i, {_tokens('coalesce(title, ' + _quote('') + ')')} AS o FROM p) SELECT model, count(*) AS calls, CAST(sum(i) AS BIGINT) AS input_tokens, round(sum(CASE model WHEN 'large' THEN i * 5.0 + o * 25.0 + 10 * 0.5 ELSE i * 1.0 + o * 5.0 + 10 * 0.1 END / 1e6), 6) AS usd, round(max(10 / (i + 10)), 6) AS best_hit_ratio FROM x GROUP BY model",
    "classify_queries": rf"WITH {_ENTRIES} SELECT seq, CASE WHEN regexp_matches(lower(query), '(^|[^\p{{L}}\p{{N}}_])(20[0-9]{{2}}|today|yesterday|latest|current)($|[^\p{{L}}\p{{N}}_])') THEN 'temporal' WHEN regexp_matches(lower(query), '(^|[^\p{{L}}\p{{N}}_])(not|don''t|never|without|no)($|[^\p{{L}}\p{{N}}_])') THEN 'negation' WHEN regexp_matches(lower(query), '(^|[^\p{{L}}\p{{N}}_])([0-9]+(\.[0-9]+)* ?(gb|mb|tb|ms|%)|port [0-9]+)($|[^\p{{L}}\p{{N}}_])') THEN 'numeric' END AS rule, CAST(coalesce(len(list_filter(string_split_regex(query, '\s+'), lambda x: x <> '')), 0) AS INTEGER) AS words FROM e",
    "routing_mix": f"WITH {_ENTRIES}, x AS (SELECT seq, lower(query) AS q, len(list_filter(string_split_regex(query, '\\s+'), lambda x: x <> '')) AS n FROM e WHERE query IS NOT NULL), y AS (SELECT CASE WHEN seq % 7 = 0 THEN 'cache_hit' WHEN regexp_matches(q, '(^|[^\\p{{L}}\\p{{N}}_])(hi|thanks)($|[^\\p{{L}}\\p{{N}}_])') THEN 'trivial' WHEN regexp_matches(q, '(^|[^\\p{{L}}\\p{{N}}_])(versus|compare|against)($|[^\\p{{L}}\\p{{N}}_])') THEN 'compares' WHEN n > 14 THEN 'long' ELSE 'default' END AS reason FROM x) SELECT CAST(CASE reason WHEN 'cache_hit' THEN 0 WHEN 'trivial' THEN 0 WHEN 'compares' THEN 2 WHEN 'long' THEN 2 ELSE 1 END AS INTEGER) AS tier, reason, count(*) AS n FROM y GROUP BY ALL",
    "cost_sensitivity": f"WITH c AS (SELECT DISTINCT raw_id, element_type, text FROM raw_chunks), t AS (SELECT element_type, CAST({_tokens('text')} AS DOUBLE) AS tokens FROM c), n AS ({_nearest('t', 'element_type', 'tokens')}) SELECT element_type, f AS factor, round(p95 * f, 6) AS p95 FROM n, (SELECT unnest([CAST(0.8 AS DOUBLE), CAST(0.9 AS DOUBLE), CAST(1.0 AS DOUBLE), CAST(1.1 AS DOUBLE), CAST(1.2 AS DOUBLE)]) AS f)",
    "context_trim": _TITLE + f", z AS (SELECT r.query_id, r.doc_id, r.rank, CAST(sum({_tokens('coalesce(p.body, ' + _quote('') + ')')}) OVER (PARTITION BY r.query_id ORDER BY r.rank) AS DOUBLE) AS running_cost, row_number() OVER (PARTITION BY r.query_id ORDER BY r.rank) AS i FROM r JOIN p ON p.id = r.doc_id) SELECT query_id, doc_id, rank, running_cost FROM z WHERE running_cost <= 1500 OR i = 1",
    "query_vectors": f"WITH {_Q_TITLE}, t AS (SELECT doc_id, {_terms('text')} AS t FROM documents WHERE text IS NOT NULL), d AS (SELECT term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest(t) AS term FROM t) GROUP BY term), w AS (SELECT DISTINCT query_id, unnest(terms) AS term FROM qt) SELECT query_id, term, round(ln(1 + ((SELECT count(*) FROM t) - coalesce(df, 0) + 0.5) / (coalesce(df, 0) + 0.5)), 6) AS weight FROM w LEFT JOIN d USING (term)",
    "distinct_documents": _fetched(50) + ", c AS (SELECT query_id, count(DISTINCT doc_id) AS n FROM m GROUP BY query_id), o AS (SELECT n, row_number() OVER (ORDER BY n) - 1 AS i, count(*) OVER () AS total FROM c) SELECT count(*) AS queries, max(CASE WHEN i = total // 2 THEN n END) AS p50, min(n) AS least FROM o",
    "degraded_answers": _fetched(20) + f", u AS (SELECT doc_id, max(source_uri) AS uri FROM qa_docs GROUP BY doc_id) SELECT query_id, 'No answer could be generated. These documents look most relevant:' || chr(10) || chr(10) || string_agg('[' || doc_rank || '] ' || coalesce(uri, '') || chr(10) || {_FIRST} || chr(10) || chr(10), '' ORDER BY doc_rank) AS answer, string_agg(CAST(z.doc_id AS VARCHAR), ',' ORDER BY doc_rank) AS doc_ids, 0 AS tier, CAST(0 AS DOUBLE) AS usd, true AS degraded FROM z LEFT JOIN u ON u.doc_id = z.doc_id WHERE doc_rank <= 3 GROUP BY query_id",
    "render_sources": _fetched(3) + f", x AS (SELECT query_id, {_rendered("string_agg('[' || rank || '] ' || text, chr(10) || chr(10) ORDER BY rank)")} AS t FROM m GROUP BY query_id) SELECT query_id, sha256(t) AS hash, {_tokens('t')} AS tokens FROM x",
    "cited_sources": _fetched(5) + ", n AS (SELECT query_id, query_id % 5 + 1 AS number FROM golden_pairs UNION SELECT query_id, query_id % 9 + 1 FROM golden_pairs) SELECT n.query_id, CAST(number AS INTEGER) AS number, m.doc_id FROM n JOIN m ON m.query_id = n.query_id AND m.rank = n.number",
    "tier_zero_answers": f"WITH {_ROUTED} SELECT query_id, tier, CASE WHEN tier = 0 THEN 'Please ask a question.' END AS answer, CASE WHEN tier = 0 THEN CAST(0 AS DOUBLE) END AS usd FROM ro",
    "cost_benchmark": _fetched(60) + f", {_ROUTED}, k AS (SELECT z.* FROM z JOIN ro USING (query_id) WHERE doc_rank <= CASE tier WHEN 1 THEN 12 WHEN 2 THEN 8 ELSE 0 END), s AS (SELECT query_id, {_rendered("string_agg('[' || doc_rank || '] ' || text, chr(10) || chr(10) ORDER BY doc_rank)")} AS t FROM k GROUP BY query_id), i AS (SELECT tier, 170 + {_tokens("coalesce(t, " + _rendered("''") + ")")} + {_tokens("coalesce(query_title, '')")} AS n FROM ro LEFT JOIN s USING (query_id)), b AS (SELECT tier, n, CASE tier WHEN 1 THEN n * 1.0 / 1e6 + 900 * 5.0 / 1e6 WHEN 2 THEN n * 5.0 / 1e6 + 900 * 25.0 / 1e6 ELSE 0 END AS cold, CASE tier WHEN 1 THEN n * 1.0 / 1e6 + 900 * 5.0 / 1e6 WHEN 2 THEN (n - 170) * 5.0 / 1e6 + 900 * 25.0 / 1e6 + 170 * 0.5 / 1e6 ELSE 0 END AS warm FROM i), o AS (SELECT *, row_number() OVER (PARTITION BY tier ORDER BY cold) - 1 AS r, count(*) OVER (PARTITION BY tier) AS c FROM b) SELECT tier, count(*) AS requests, CAST(sum(n) AS BIGINT) AS tokens_in, round(sum(warm), 6) AS warm_usd, {', '.join(f'round(max(CASE WHEN r = CAST(floor((c - 1) * {q}) AS BIGINT) THEN cold END), 6) AS p{round(q * 100)}' for q in (0.5, 0.95, 0.99))} FROM o GROUP BY tier",
    "cache_outcomes": _OUTCOMES + " SELECT query_id, tenant, outcome, CASE WHEN outcome = 'semantic' THEN near_seq ELSE exact_seq END AS hit_seq, CASE WHEN outcome = 'semantic' THEN s END AS similarity, refused FROM o",
    "request_costs": f"WITH {_CALLS} SELECT request, model, count(*) AS n_calls, CAST(sum(ti) AS BIGINT) AS input_tokens, CAST(sum(tw) AS BIGINT) AS output_tokens, CAST(sum(cw) AS BIGINT) AS cache_write_tokens, CAST(sum(cr) AS BIGINT) AS cache_read_tokens, round(sum(CASE model WHEN 'large' THEN ti * 5.0 + tw * 25.0 + cw * (CASE ttl WHEN '1h' THEN 10.0 ELSE 6.25 END) + cr * 0.5 ELSE ti * 1.0 + tw * 5.0 + cw * (CASE ttl WHEN '1h' THEN 2.0 ELSE 1.25 END) + cr * 0.1 END / 1e6), 6) AS usd FROM ca GROUP BY ALL",
    "cost_projection": f"WITH {_CALLS}, x AS (SELECT model, CASE model WHEN 'large' THEN ti * 5.0 + 900 * 25.0 + cr * 0.5 ELSE ti * 1.0 + 900 * 5.0 + cr * 0.1 END / 1e6 AS usd FROM ca) SELECT model, count(*) AS calls, round(sum(usd), 6) AS usd, round(max(usd), 9) AS most FROM x GROUP BY model",
    "cache_breakeven": "SELECT model, round(CAST((w5 - i) / (i - r) AS DOUBLE), 6) AS reads_5m, round(CAST((w1 - i) / (i - r) AS DOUBLE), 6) AS reads_1h FROM (VALUES ('small', 1.0, 1.25, 2.0, 0.1), ('large', 5.0, 6.25, 10.0, 0.5)) AS t(model, i, w5, w1, r)",
    "record_totals": f"WITH {_RECORDS} SELECT event_id, round(CASE WHEN ends_with(event_type, '_total') THEN search ELSE micros + search END / 1000, 3) AS total_ms, 2 AS n_stages FROM re",
    "record_attributes": f"WITH {_RECORDS} SELECT event_id, 'cache_outcome=' || cache_outcome || ' cache_read_tokens=' || cr || CASE WHEN cache_outcome = 'semantic_hit' THEN ' cache_similarity=0.9688' ELSE '' END || ' cache_write_tokens=0 candidates=' || (event_id % 60) || ' cost_usd=' || printf('%.6f', usd) || ' degraded=' || CASE WHEN degraded THEN 'true' ELSE 'false' END || ' input_tokens=' || ti || ' model=small output_tokens=' || tw || ' price_version=v1 route_tier=' || route_tier || ' tenant=' || tenant AS attributes FROM re",
    "cost_histogram": f"WITH {_RECORDS} " + _buckets("re", "tenant, route_tier, cache_outcome, degraded", "usd", _COST_BUCKETS),
    "stage_histogram": f"WITH {_RECORDS}, sg AS (SELECT event_type AS stage, tenant, micros / 1e6 AS v FROM re UNION ALL SELECT 'search', tenant, search / 1e6 FROM re UNION ALL SELECT 'retrieval_total', tenant, (micros + search) / 1e6 FROM re) " + _buckets("sg", "stage, tenant", "v", LATENCY_BOUNDS),
    "token_usage": f"WITH {_RECORDS}, tu AS (SELECT tenant, route_tier, 'input' AS token_class, ti AS v FROM re UNION ALL SELECT tenant, route_tier, 'output', tw FROM re UNION ALL SELECT tenant, route_tier, 'cache_read', cr FROM re) SELECT tenant, route_tier, token_class, count(*) AS n, CAST(sum(v) AS DOUBLE) AS tokens FROM tu WHERE v <> 0 GROUP BY ALL",
    "rate_ratios": f"WITH {_RECORDS}, x AS (SELECT *, time_bucket(INTERVAL '6 hours', ts) - i * INTERVAL '6 hours' AS window_start FROM re, (SELECT unnest(range(4)) AS i)) SELECT window_start, count(*) AS n, round(count(*) FILTER (WHERE cache_outcome <> 'miss') / count(*), 6) AS hit_rate, round(count(*) FILTER (WHERE degraded) / count(*), 6) AS degraded_rate FROM x GROUP BY window_start",
    "slo_summary": _LATENCY + ", s AS (SELECT stage AS name, coalesce(p95_ms <= 150, false) AS passed, p95_ms <= 150 AND round((150 - p95_ms) / 150, 6) < 0.1 AS tight FROM lat) SELECT coalesce(bool_and(passed), true) AS passed, count(*) AS n_checks, coalesce(string_agg(name, ',' ORDER BY name) FILTER (WHERE NOT passed), '') AS failures, coalesce(string_agg(name, ',' ORDER BY name) FILTER (WHERE tight), '') AS tight, 'local' AS host, 'true' AS warm FROM s",
    "load_schedule": "SELECT i, CAST(floor(i * 1000000 / 50) AS BIGINT) AS intended_us, i < 20 AS warmup FROM (SELECT unnest(range(420)) AS i)",
    "decode_rate": "SELECT event_id, round(CASE WHEN value * 10 - event_id % 100 > 0 THEN (event_id % 500) / ((value * 10 - event_id % 100) / 1000) ELSE 0 END, 6) AS tokens_per_second FROM events",
    "affordable_context": "SELECT event_id, CAST(CASE WHEN event_id % 4 = 0 THEN 513 ELSE least(floor(greatest(value / 1000 - 0.03125, 0) / ((event_id % 4) / 4096)), 513) END AS INTEGER) AS chunks FROM events",
    "encoder_sweep": f"WITH sw AS (SELECT event_type AS encoder, CAST(event_id % 4 + 1 AS INTEGER) AS threads, CAST(floor(value * 1000) AS BIGINT) AS micros FROM events), r AS (SELECT encoder, threads, count(micros) AS n, {', '.join(f'round(quantile_disc(micros, {q}) / 1000, 6) AS p{round(q * 100)}_ms' for q in (0.5, 0.95, 0.99))}, round(max(micros) / 1000, 6) AS max_ms, round(avg(micros) / 1000, 6) AS mean_ms FROM sw GROUP BY ALL) SELECT *, row_number() OVER (ORDER BY p95_ms, encoder, threads) = 1 AS best FROM r",
    "ingest_projection": "WITH m AS (SELECT event_type AS configuration, count(*) / (sum(floor(value * 1000)) / 1e6) AS per_second FROM events WHERE event_id % 2 = 0 GROUP BY ALL ORDER BY per_second DESC, configuration LIMIT 1) SELECT label, CAST(n AS BIGINT) AS n_chunks, configuration, round(per_second, 6) AS per_second, round(n / per_second / 3600, 6) AS hours FROM m, (VALUES ('all', 638156), ('some', 100000)) AS w(label, n)",
    "stage_windows": "SELECT time_bucket(INTERVAL '1 day', ts) AS window_start, event_type AS stage, count(micros) AS n, quantile_disc(micros, 0.5) AS p50, quantile_disc(micros, 0.95) AS p95, max(micros) AS most FROM (SELECT *, CAST(floor(value * 1000) AS BIGINT) AS micros FROM events) GROUP BY ALL",
    "posts_xml": f"WITH {_CUR} SELECT id, post_type_id, parent_id, accepted_answer_id, coalesce(score, 0) AS score, coalesce({_TITLE_TEXT}, '') AS title, array_to_string({_tags('tags')}, ',') AS tags FROM p",
    "links_xml": "SELECT id, post_id, related_post_id FROM post_links WHERE link_type_id = 3 AND post_id <> related_post_id",
    "index_upsert": f"WITH c AS (SELECT DISTINCT doc_id, {_chunk_id('text')} AS chunk_id FROM raw_chunks WHERE text IS NOT NULL), t AS (SELECT 'a' AS tenant_id, chunk_id FROM c UNION SELECT 'b', chunk_id FROM c WHERE doc_id % 2 = 0) SELECT tenant_id, count(*) AS n_chunks, count(DISTINCT chunk_id) AS n_ids, CAST(count(*) AS INTEGER) AS added, 0 AS again FROM t GROUP BY tenant_id",
    "term_stats_saved": f"WITH t AS (SELECT doc_id, {_terms('text')} AS t FROM documents WHERE text IS NOT NULL), d AS (SELECT term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest(t) AS term FROM t) GROUP BY term) SELECT count(*) AS n_terms, CAST(sum(df) AS BIGINT) AS sum_df, max(df) AS max_df, (SELECT count(*) FROM t) AS doc_count, (SELECT CAST(sum(len(t)) AS BIGINT) FROM t) AS total_len FROM d",
    "golden_saved": "SELECT query_id, gold_doc_id, query_title, 'golden_pairs' AS source FROM golden_pairs",
    "sparse_attached": f"WITH {_CHUNKS}, f AS (SELECT doc_id, len, term, count(*) AS tf FROM (SELECT doc_id, len(terms) AS len, unnest(terms) AS term FROM d) GROUP BY ALL), w AS (SELECT doc_id, term, tf * CAST(2.2 AS DOUBLE) / (tf + CAST(1.2 AS DOUBLE) * (0.25 + 0.75 * len / (SELECT greatest(1.0, sum(len(terms)) / count(*)) FROM d WHERE terms IS NOT NULL))) AS x FROM f) SELECT d.doc_id AS chunk_id, CAST(count(term) AS INTEGER) AS n_terms, round(sum(x), 6) AS weight, min(term) AS first_term FROM d LEFT JOIN w ON w.doc_id = d.doc_id GROUP BY d.doc_id",
    "sse_completions": "SELECT doc_id AS stream, coalesce(title, '') AS text, 'm' AS model, coalesce(n_chars, 0) AS input_tokens, CAST(0 AS BIGINT) AS cache_read_tokens, CAST(length(coalesce(title, '')) AS BIGINT) AS output_tokens, 'end_turn' AS stop_reason, CAST(NULL AS VARCHAR) AS error FROM documents",
    "pipeline_tags": "SELECT coalesce(lang, 'none') || '/chunk1/e1' AS tag, count(*) AS n FROM documents GROUP BY ALL",
    "dense_knn_tags": "WITH e AS (SELECT vec_id, tags, CAST(embedding AS DOUBLE[]) AS v FROM embeddings LEFT JOIN documents ON doc_id = vec_id WHERE len(embedding) = 64), s AS (SELECT q.vec_id AS query_id, d.vec_id AS doc_id, list_dot_product(q.v, d.v) / (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(d.v, d.v))) AS c FROM e q JOIN e d ON q.vec_id <> d.vec_id AND (coalesce(len(q.tags), 0) = 0 OR list_has_any(q.tags, d.tags)) WHERE q.vec_id % 20 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(c, 9) DESC, doc_id) AS rank FROM s) SELECT query_id, doc_id, CAST(rank AS INTEGER) AS rank, round(round(c, 9), 6) AS score FROM r WHERE rank <= 10",
    "scan_limit": "SELECT least(100, count(*)) AS n FROM posts",
    "chunk_coverage": rf"WITH q AS (SELECT DISTINCT doc_id, coalesce(title, '') || chr(10) || chr(10) || coalesce(body, '') || coalesce(array_to_string(list_transform(answers, lambda a, i: chr(10) || chr(10) || 'Answer ' || i || ':' || chr(10) || coalesce(a, '')), ''), '') AS t FROM qa_docs), k AS (SELECT doc_id, {_hash('t')} AS h, regexp_replace(t, '[{_WS}`]+', '', 'g') AS t FROM q) SELECT doc_id, sha256(any_value(t)) AS hash, true AS numbered, true AS within FROM k WHERE t <> '' GROUP BY doc_id, h",
    "chunk_documents": rf"WITH {_CHUNKED}, h AS (SELECT *, {_hash('display_text')} AS content_hash, {_chunk_id('display_text')} AS chunk_id FROM c) SELECT chunk_id, regexp_replace(chunk_id, '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})$', '\1-\2-\3-\4-\5') AS chunk_uuid, doc_id, chunk_index, chunk_count, content_hash, element_type, token_count, split_code, coalesce(title, '') || CASE WHEN len(tags) > 0 THEN ' [' || array_to_string(tags, ', ') || ']' ELSE '' END || chr(10) || display_text AS text, 'html1/chunk1/none' AS pipeline_version FROM h",
    "chunk_stats": f"WITH {_CHUNKED} {_CHUNK_STATS}",
    "links_fingerprint": "SELECT count(*) AS n_rows, CAST(sum(CAST(CAST('0x' || substr(md5(concat_ws('|', coalesce('=' || id, '~'), coalesce('=' || post_id, '~'), coalesce('=' || related_post_id, '~'), coalesce('=' || link_type_id, '~'), coalesce('=' || creation_date, '~'))), 1, 15) AS BIGINT) AS HUGEINT)) AS VARCHAR) AS fingerprint FROM post_links",
    "slo_budgets": _LATENCY + ", b AS (SELECT * FROM (VALUES ('click', 150), ('error', 60), ('view', 90)) AS t(name, budget)) SELECT name, CAST(budget AS DOUBLE) AS budget, true AS lower_is_better, p95_ms AS measured, p95_ms <= budget AS passed, round((budget - p95_ms) / budget, 6) AS headroom, p95_ms <= budget AND round((budget - p95_ms) / budget, 6) < 0.1 AS tight FROM b JOIN lat ON lat.stage = b.name",
    "embedded_documents": rf"WITH x AS (SELECT doc_id, CASE WHEN regexp_matches(coalesce(text, ''), '[^{_WS}\x1c-\x1f]') THEN 'Represent this sentence for searching relevant passages: ' || text END AS t FROM documents) SELECT doc_id, CAST(length(t) AS DOUBLE) AS n_chars, CAST(length(t) - length(replace(t, ' ', '')) AS DOUBLE) AS n_blanks, CAST(length(t) - length(replace(t, chr(10), '')) AS DOUBLE) AS n_lines FROM x",
    "streamed_documents": rf"SELECT DISTINCT id AS doc_id, 'public' AS tenant_id, true AS once FROM posts WHERE post_type_id = 1 AND regexp_matches(coalesce(title, '') || coalesce({_clean('body')}, ''), '[^{_WS}]')",
    "cache_streamed": _OUTCOMES.replace("WHERE seq % 20 = 0", "WHERE e.inserted_at IS NOT NULL").replace("WHERE a.seq % 20 = 0 AND", "WHERE") + " SELECT query_id, tenant, outcome, CASE WHEN outcome = 'semantic' THEN near_seq ELSE exact_seq END AS hit_seq, CASE WHEN outcome = 'semantic' THEN s END AS similarity, refused FROM o",
    "cache_exact_streamed": f"WITH {_ENTRIES}, k AS (SELECT seq, lag(seq) OVER (PARTITION BY {_KEY} ORDER BY seq) AS hit_seq FROM e WHERE tenant IS NOT NULL AND query IS NOT NULL) SELECT seq, CASE WHEN hit_seq IS NULL THEN 'miss' ELSE 'exact' END AS outcome, hit_seq FROM k",
    "load_lines": "WITH x AS (SELECT event_type, (event_id % 13) * 5000 AS delay, CASE WHEN event_id % 50 <> 0 THEN CAST(floor(value * 1000) AS BIGINT) END AS good FROM events), r AS (SELECT event_type, count(*) AS n, quantile_disc(good + delay, 0.95) / 1000 AS c, quantile_disc(good, 0.95) / 1000 AS b, max(delay) / 1000 AS d, 100 * round((count(*) - count(good)) / count(*), 6) AS e FROM x GROUP BY event_type) SELECT event_type, printf('n=%-6d err %5.2f%%  corrected p95 %8.2f ms  naive p95 %8.2f ms  max delay %8.2f ms', n, e, c, b, d) || CASE WHEN d > 50 THEN '  << fell behind' ELSE '' END AS line FROM r",
}
