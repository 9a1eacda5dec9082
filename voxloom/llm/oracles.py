"""DuckDB SQL for those queries that SQL can express."""

from __future__ import annotations

from voxloom.llm import lexical_search as ls
from voxloom.llm import line_quality as lq
from voxloom.llm import spelling as sp
from voxloom.llm import temperature_mix as tm
from voxloom.llm import url_filter as uf


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def url_filter() -> str:
    rules = sorted(uf.RULES, key=lambda r: -len(r[1] + r[2]))
    fits = lambda h, p: f"(host = {quoted(h)} or ends_with(host, {quoted('.' + h)})) and starts_with(path, {quoted(p)})"
    rule = " ".join(f"when {fits(h, p)} then {quoted(h + p)}" for _, h, p in rules)
    verdict = " ".join(f"when {fits(h, p)} then {quoted(v)}" for v, h, p in rules)
    held = ", ".join(map(quoted, uf.HELD_BACK))
    k = uf.ORDER
    chars = f"""select gram, right(gram, 1) c, a, r from counts"""
    steps, last = [], "p0"
    for i in range(1, k + 1):
        steps.append(f"""
    own{i} as (select right(gram, {i + 1}) g, sum(a) na, sum(r) nr from counts group by 1),
    con{i} as (select left(g, {i}) h, sum(na) ta, sum(nr) tr, count(*) filter (na > 0) da, count(*) filter (nr > 0) dr from own{i} group by 1),
    p{i} as (select gram,
        case when ta > 0 then (coalesce(na, 0) + da * pa) / (ta + da) else pa end pa,
        case when tr > 0 then (coalesce(nr, 0) + dr * pr) / (tr + dr) else pr end pr
      from {last} left join own{i} on right(gram, {i + 1}) = own{i}.g left join con{i} on left(right(gram, {i + 1}), {i}) = con{i}.h),""")
        last = f"p{i}"
    base = lambda x: f"(case when (select t{x} from totals) > 0 then ((select k{x} from totals) / {uf.SYMBOLS}.0) / greatest(1, (select t{x} + k{x} from totals)) else 1 / {uf.SYMBOLS}.0 end)"
    one = lambda x: f"coalesce((s.{x} + (select k{x} from totals) / {uf.SYMBOLS}.0) / (select t{x} + k{x} from totals), {base(x)})"
    return f"""
    with split as (
      select page_id, url,
        translate(coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), ''), '{uf.UPPER}', '{uf.LOWER}') host,
        coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') path from pages),
    ruled as (select *, case {rule} end rule, case {verdict} end ruled from split),
    urls as (select url, any_value(host) || any_value(path) hp, max(case ruled when 'allow' then 1 when 'block' then 0 end) label,
        left(md5(url), 1) in ({held}) held from ruled where url is not null and host || path <> '' group by url),
    marked as (select url, label, held, '{uf.START * k}' || regexp_replace(translate(hp, '{uf.UPPER}', '{uf.LOWER}'), '[^a-z0-9/._%-]', '~', 'g') || '{uf.END}' s from urls),
    grams as (select url, label, held, unnest(list_transform(range(1, len(s) - {k} + 1), lambda i: substr(s, i, {k + 1}))) gram from marked),
    counts as (select gram, sum(label) a, sum(1 - label) r from grams where label is not null and not held group by 1),
    single as (select c, sum(a) a, sum(r) r from ({chars}) group by 1),
    totals as (select coalesce(sum(a), 0) ta, coalesce(sum(r), 0) tr, count(*) filter (a > 0) ka, count(*) filter (r > 0) kr from single),
    wanted as (select distinct gram from grams where label is null or held),
    p0 as (select gram, {one('a')} pa, {one('r')} pr from wanted left join single s on s.c = right(gram, 1)),{''.join(steps)}
    scored as (select url, any_value(label) label, round(avg(ln(pa) - ln(pr)), 6) score from grams join {last} using (gram) where label is null or held group by url),
    bins as (select greatest(-1000, least(1000, floor(score * 100))) bin, sum(label) a, sum(1 - label) r from scored where label is not null group by 1),
    cuts as (select bin, coalesce(sum(a) over before, 0) ba, coalesce(sum(r) over before, 0) br, sum(a) over () good, sum(r) over () bad
      from bins window before as (order by bin rows between unbounded preceding and 1 preceding)),
    best as (select bin / 100 cut from cuts where good > 0 and bad > 0 order by round((good - ba) / good + br / bad, 9) desc, bin limit 1)
    select page_id, host, path, rule, coalesce(ruled, case when score < (select cut from best) then 'block' else 'allow' end) verdict
    from ruled left join scored using (url)"""


def line_quality() -> str:
    word = r"[^\x20\x09-\x0D]+"
    trim = f"regexp_replace(regexp_replace(line, '^[\\x20\\x09-\\x0D]+', ''), '[\\x20\\x09-\\x0D]+$', '')"
    count = lambda chars: f"(len(bare) - len(regexp_replace(bare, {quoted('[' + chars + ']')}, '', 'g')))"
    pairs = lambda c: f"(len(string_split(bare, {quoted(c * 2)})) - 1)"
    ends = " or ".join(f"ends_with(bare, {quoted(e)})" for e in lq.ENDS)
    phrases = " or ".join(f"contains(lower(bare), {quoted(p)})" for p in lq.PHRASES)
    return f"""
    with base as (
      select row_number() over () k, doc_id, coalesce(text, '') t from documents),
    words as (select k, doc_id, t, regexp_extract_all(t, '{word}') w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{word}')) l from base),
    windows as (select k, i, w[i:i + 2] x from (select k, w, unnest(range(1, len(w) - 1)) i from words)),
    often as (select k, i from windows qualify count(*) over (partition by k, x) > 1),
    covered as (select k, count(distinct j) n from (select k, unnest([i, i + 1, i + 2]) j from often) group by k),
    lines as (select k, line, {trim} bare, len(regexp_extract_all(line, '{word}')) n from (select k, unnest(l) line from words)),
    judged as (select k, n, case
        when {count('|›»•·')} > {lq.MAX_SEPARATORS_A_WORD} * n or (n <= {lq.FEW_WORDS} and not ({ends})) then 'navigation'
        when {count('#*$%&|<>')} + {pairs('!')} + {pairs('?')} > {lq.MAX_MARKS_A_WORD} * n or not regexp_matches(bare, '[\\pL\\pN]') then 'punctuation'
        when n <= 40 and ({phrases}) then 'boilerplate' end fault from lines),
    faults as (select k, count(*) filter (fault = 'navigation') n_navigation, count(*) filter (fault = 'punctuation') n_punctuation,
        count(*) filter (fault = 'boilerplate') n_boilerplate, coalesce(sum(n) filter (fault is not null), 0)::bigint lost_words from judged group by k),
    found as (select doc_id, len(w) n_words, coalesce(list_sum(list_transform(w, lambda x: len(x))), 0)::bigint word_chars,
        len(t) - len(regexp_replace(t, '[#*$%&|<>]', '', 'g')) n_symbols, len(l) - len(list_distinct(l)) n_dup_lines, coalesce(n, 0) n_repeat_words,
        len(l) n_lines, coalesce(n_navigation, 0) n_navigation, coalesce(n_punctuation, 0) n_punctuation, coalesce(n_boilerplate, 0) n_boilerplate, coalesce(lost_words, 0) lost_words
      from words left join covered using (k) left join faults using (k))
    select *, n_words < {lq.MIN_WORDS} or 100 * n_repeat_words > {lq.MAX_REPEATED_PERCENT} * n_words base_failed,
      not (n_words < {lq.MIN_WORDS} or 100 * n_repeat_words > {lq.MAX_REPEATED_PERCENT} * n_words) and lost_words <= {lq.MAX_LOST} * n_words kept
    from found"""


def temperature_mix() -> str:
    measure = lambda e: f"(select (ln(sum(pow(p, {e}))) - {e} * sum(pow(p, {e}) * ln(p)) / sum(pow(p, {e}))) / ln(count(*)) from shares)"
    repeats = lambda e: f"(select max(pow(p, {e} - 1)) / sum(pow(p, {e})) from shares)"
    steps = tm.HALVINGS * tm.PASSES
    return f"""
    with recursive docs as (
      select doc_id, source, coalesce('+' || source, '-') s, coalesce(len(regexp_extract_all(text, '{tm.WORD}')), 0) n_tokens from documents),
    sources as (select s, sum(n_tokens)::bigint tokens, count(*) n from docs group by s),
    total as (select sum(tokens)::double t from sources),
    shares as (select tokens / (select t from total) p from sources where tokens > 0),
    flat as (select 0 step, 0.0::double low, 1.0::double high union all
      select step + 1, case when {measure('((low + high) / 2)')} >= {tm.ENTROPY} then (low + high) / 2 else low end,
        case when {measure('((low + high) / 2)')} >= {tm.ENTROPY} then high else (low + high) / 2 end from flat where step < {steps}),
    spared as (select 0 step, 0.0::double low, 1.0::double high union all
      select step + 1, case when {repeats('((low + high) / 2)')} <= {tm.REPEATS} then low else (low + high) / 2 end,
        case when {repeats('((low + high) / 2)')} <= {tm.REPEATS} then (low + high) / 2 else high end from spared where step < {steps}),
    power as (select case when (select count(*) from shares) < 2 then 1.0 else greatest(
        case when {measure('1.0')} >= {tm.ENTROPY} then 1.0 else (select low from flat where step = {steps}) end,
        case when {repeats('0.0')} <= {tm.REPEATS} then 0.0 else (select high from spared where step = {steps}) end) end e),
    weighed as (select *, case when tokens > 0 then round(pow(tokens / (select t from total), (select e from power)) / (select sum(pow(p, (select e from power))) from shares), 9) else 0.0 end weight from sources),
    quotas as (select *, floor(weight * (select t from total) + 0.5)::bigint quota from weighed),
    passes as (select *, case when tokens > 0 then quota // tokens else 0 end passes, quota - (case when tokens > 0 then quota // tokens else 0 end) * tokens rest, greatest(1, ceil(n / {tm.BLOCK_ROWS}.0)) blocks from quotas),
    spread as (select doc_id, source, s, n_tokens, weight, passes, rest, blocks, unnest(range(0, passes + 1)) epoch from docs join passes using (s)),
    hashed as (select *, ('0x' || left(md5('{tm.SEED}:' || epoch || ':' || doc_id), 8))::bigint / 4294967296.0::double h from spread),
    placed as (select *, floor(h * blocks)::int block from hashed),
    ordered as (select *, row_number() over (partition by s, epoch, block order by h, doc_id) slot, sum(n_tokens) over (partition by s, epoch order by block, h, doc_id rows unbounded preceding) upto from placed)
    select doc_id, source, n_tokens, weight, epoch::int epoch, block, slot::int slot from ordered where epoch < passes or upto <= rest or n_tokens = 0"""


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def spelling_variants() -> str:
    """The hash is a fold over bytes with the usual table; near words share what is left after one deletion, or are it."""
    return f"""
    with recursive crc_table as materialized (select list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, i)) t),
    docs as (select coalesce(doc_id::varchar, '') id, translate(text, '{UPPER}', '{LOWER}') t from documents where text is not null),
    runs as (select id, run, count(*) k from (select id, unnest(regexp_extract_all(t, '[a-zÀ-ÿ]+')) run from docs) group by all),
    long_runs as (select id, run, k, flatten(list_transform(string_split(id || ':' || run, ''), lambda c: case when unicode(c) < 128 then [unicode(c)::bigint] else [195::bigint, unicode(c)::bigint - 64] end)) b from runs where length(run) >= {sp.LEAST_LETTERS}),
    hashed as (select run, k, xor(list_reduce(b, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), 4294967295), 4294967295) h from long_runs, crc_table),
    slipped as (select case when h % {sp.SLIPS} = 0 then left(run, (h % length(run))::int) || substr(run, (h % length(run))::int + 2) else run end word, k from hashed),
    words as materialized (select word, sum(k)::bigint n from slipped where length(word) >= {sp.LEAST_LETTERS} group by word having sum(k) >= {sp.LEAST_COUNT}),
    cut as materialized (select word, n, i, left(word, i - 1) || substr(word, i + 1) d from (select word, n, unnest(range(1, length(word) + 1))::int i from words)),
    near as (select a.word, b.word other, b.n m from cut a join cut b on a.d = b.d and a.i = b.i and a.word <> b.word union select a.word, b.word, b.n from cut a join words b on a.d = b.word union select b.word, a.word, a.n from cut a join words b on a.d = b.word),
    best as (select word, count(*) n_near, first(other order by m desc, other) other, max(m) m from near group by word),
    formed as materialized (select word, n, coalesce(n_near, 0) n_near, case when m >= {sp.RATIO} * n then other end form, case when m >= {sp.RATIO} * n then m end form_n from words left join best using (word)),
    chain as (select word, form at_word from formed where form is not null union all select c.word, f.form from chain c join formed f on f.word = c.at_word where f.form is not null),
    last as (select c.word, c.at_word root from chain c join formed f on f.word = c.at_word where f.form is null)
    select word, form, coalesce(root, word) root, n, n_near, form_n from formed left join last using (word)"""


def lexical_search() -> str:
    terms = f"regexp_extract_all(translate({{0}}, '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
    return f"""
    with asked as (select item_id, item, unnest(list_distinct({terms.format("coalesce(text, '')")})) term from (select *, row_number() over () item from benchmark)),
    docs as (select doc_id, row, {terms.format("coalesce(text, '')")} terms from (select doc_id, text, row_number() over () row from documents)),
    sizes as (select doc_id, row, len(terms) n from docs where len(terms) > 0),
    total as (select count(*) many, sum(n)::bigint length from sizes),
    tfs as (select row, term, count(*) tf from (select row, unnest(terms) term from docs) where term in (select term from asked) group by all),
    weights as (select term, floor(1000 * ln((2 * many + 2) / (2 * count(*) + 1)))::bigint w from tfs, total group by term, many),
    scores as (select item, any_value(item_id) item_id, row, any_value(doc_id) doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - {ls.LENGTH_SHARE} + (({ls.LENGTH_SHARE} * n * many) // length)))))::bigint score
      from asked join weights using (term) join tfs using (term) join sizes using (row), total group by item, row)
    select item_id, rank, doc_id, score from (select *, (row_number() over (partition by item order by score desc, doc_id))::int rank from scores where score > 0) where rank <= {ls.K}"""


def exact_dedup() -> str:
    return """
    with texts as (select doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') t from documents),
    hashed as (select doc_id, sha256(t) text_sha256, row_number() over (partition by t order by doc_id) place, first_value(doc_id) over (partition by t order by doc_id) keep_id, count(*) over (partition by t) group_size from texts)
    select doc_id, keep_id, group_size, place = 1 kept, text_sha256 from hashed"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_url_filter": url_filter(),
        "op2_line_quality": line_quality(),
        "op7_temperature_mix": temperature_mix(),
        "op11_spelling_variants": spelling_variants(),
        "op12_lexical_search": lexical_search(),
        "op13_exact_dedup": exact_dedup(),
    }
