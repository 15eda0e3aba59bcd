"""SQL twins of the text operators that SQL can express."""

ORACLES: dict[str, str] = {}

ORACLES["op1_quality_rules"] = r"""
with texts as (
  select row_number() over () as id, doc_id, coalesce(text, '') as t, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) as blanks
  from documents
), parts as (
  select id, doc_id, t,
    case when trim(t, blanks) = '' then cast([] as varchar[]) else string_split_regex(trim(t, blanks), '[ \t-\r]+') end as words,
    list_filter(string_split(t, chr(10)), lambda l: trim(l, blanks) <> '') as lines
  from texts
), windows as (
  select id, i, array_to_string(words[i:i + 7], ' ') as phrase
  from (select id, words, unnest(range(1, len(words) - 6)) as i from parts where len(words) > 8)
), again as (
  select id, i from windows qualify count(*) over (partition by id, phrase) > 1
), covered as (
  select id, sum(step) as n from (select id, least(8, coalesce(lead(i) over (partition by id order by i) - i, 8)) as step from again) group by id
), counts as (
  select doc_id, t, words, lines, len(words)::bigint as n_words, length(array_to_string(words, ''))::bigint as word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
    (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, coalesce(n, 0)::bigint as n_repeat_words
  from parts left join covered using (id)
), judged as (
  select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed,
    n_symbols > 0.25 * n_words
    or word_chars < 2 * n_words or word_chars > 20 * n_words
    or n_dup_lines > 0.4 * len(lines)
    or length(t) - length(regexp_replace(t, '[A-ZÀ-ÖØ-Þ]+', '', 'g')) > 0.5 * word_chars
    or length(t) - length(replace(t, '!', '')) > 0.3 * n_words
    or length(t) - length(regexp_replace(t, '[0-9]+', '', 'g')) > 0.4 * word_chars
    or (n_words >= 50 and len(list_distinct(words)) < 0.1 * least(n_words, 1000)) as rejected
  from counts
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and not rejected as kept from judged
"""

ORACLES["op7_url_filters"] = r"""
with split as (
  select page_id,
    coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') as path
  from pages
), rules(verdict, rule_host, rule_path) as (
  values ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
         ('block', 'net', '/es/'), ('block', 'net', '/fr/')
), matched as (
  select page_id, host, path, rule_host || rule_path as rule, verdict,
    row_number() over (partition by page_id order by length(rule_host || rule_path) desc nulls last) as n
  from split left join rules
    on (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path)
)
select page_id, host, path, rule, coalesce(verdict, 'allow') as verdict from matched where n = 1
"""

ORACLES["op9_chat_formatting"] = r"""
with messages as (
  select conv_id::bigint as conv_id, turn::bigint as turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'
)
select conv_id, count(*)::bigint as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  sum(length('### : </turn>') + 1 + length(role || text) + length(regexp_replace(role || text, '[^\\#<:]', '', 'g')))::bigint as formatted_chars
from messages group by conv_id
"""

#: A pattern for each kind, in their order: the whole pattern, and the test of a match ``m``.
SECRETS = [
    (
        "assign",
        r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""",
        r"""length(regexp_replace(m, '^[A-Za-z_]+["'']?\x20*[:=]\x20*["'']?', '')) >= 6""",
    ),
    ("access", "AKIA[A-Z0-9]+", "length(m) >= 20"),
    ("hex", "[0-9a-f]+", "length(m) >= 24"),
    ("pem", "-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", "true"),
    ("github", "gh[pousr]_[A-Za-z0-9]{36,}", "true"),
    ("login", r"://[^/:@ \t\n\r]+:[^/:@ \t\n\r]+@", "true"),
]
MATCHES = " union all ".join(
    f"select r, {place} as place, '{kind}' as kind, unnest(regexp_extract_all(text, '{pattern}')) as m, "
    f"unnest(regexp_split_to_array(text, '{pattern}')[:-2]) as gap, unnest(range(1, 1 + len(regexp_extract_all(text, '{pattern}')))) as i from texts"
    for place, (kind, pattern, _) in enumerate(SECRETS)
)
KEEPS = " ".join(f"when '{kind}' then {keeps}" for kind, _, keeps in SECRETS)
ORACLES["op11_secret_scans"] = f"""
with texts as (select row_number() over () as r, doc_id::bigint as doc_id, coalesce(text, '') as text from documents),
matches as ({MATCHES}),
placed as (
  select r, place, kind, m, (sum(length(gap) + length(m)) over (partition by r, place order by i))::bigint as stop from matches
), kept as (
  select r, place, kind, stop - length(m) as start, kind || ':' || (stop - length(m)) || ':' || stop as span
  from placed where case kind {KEEPS} end
), found as (
  select r, count(*) filter (place = 0) as n_assign, count(*) filter (place = 1) as n_access, count(*) filter (place = 2) as n_hex,
    string_agg(span, ',' order by start, place) filter (place < 3) as base, string_agg(span, ',' order by start, place) as spans
  from kept group by r
)
select doc_id, coalesce(n_assign, 0)::bigint as n_assign, coalesce(n_access, 0)::bigint as n_access, coalesce(n_hex, 0)::bigint as n_hex,
  sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from texts left join found using (r)
"""

TERMS = r"""regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""
ORACLES["op12_lexical_search"] = f"""
with words as (select r, doc_id, unnest({TERMS}) as w from (select row_number() over () as r, doc_id, text from documents)),
held as (select r, any_value(doc_id) as doc_id, w, count(*)::bigint as tf from words group by r, w),
sizes as (select r, sum(tf)::bigint as n from held group by r),
corpus as (select count(*)::bigint as docs, sum(n)::bigint as total from sizes),
asked as (select item_id, w, count(*)::bigint as k from (select item_id, unnest({TERMS}) as w from benchmark) group by item_id, w),
weights as (
  select w, floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1)::double))::bigint as weight
  from held, corpus where w in (select w from asked) group by w
), scores as (
  select item_id, r, doc_id::bigint as doc_id,
    sum(k * weight * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * docs) // total))))::bigint as score
  from asked join held using (w) join weights using (w) join sizes using (r), corpus group by item_id, r, doc_id
), ranked as (
  select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from scores where score > 0
)
select item_id::bigint as item_id, rank::int as rank, doc_id, score from ranked where rank <= 10
"""
