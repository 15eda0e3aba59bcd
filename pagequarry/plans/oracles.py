"""The same answers in plain SQL, straight from the tables.

Stored pages are read with regular expressions; for rendered pages the answer is
in the columns they were rendered from.
"""

from __future__ import annotations

SITE = "https://films.example.com"
# every label of the default content type, in order
LABELS = [
    ("title", ["Title", "Film Title", "Movie", "ဇာတ်ကားအမည်", "Titre du film", "映画タイトル"]),
    ("year", ["Year", "Release Year", "နှစ်", "ခုနှစ်", "Année de sortie", "年"]),
    ("director", ["Director", "Directed By", "Filmmaker", "ဒါရိုက်တာ", "Réalisateur"]),
    ("genre", ["Genre", "Category", "Type", "အမျိုးအစား", "ジャンル"]),
    ("duration", ["Duration", "Running Time", "Runtime", "ချိန်အကြာ", "ကြာချိန်", "Durée"]),
    ("cast", ["Cast", "Actors", "Starring", "သရုပ်ဆောင်", "Acteurs"]),
]
SPACES = r"[\s\x0B\x{85}\p{Z}]"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{SPACES}+|{SPACES}+$', '', 'g')"


def clean(x: str) -> str:
    text = f"replace(coalesce({x}, ''), chr(160), ' ')"
    return strip(rf"regexp_replace({text}, '^[^:\-–]*[:\-–]', '')")


def unescape(x: str) -> str:
    return f"replace(replace({x}, '&quot;', '\"'), '&amp;', '&')"


# ---- stored pages ----

ORIGIN = r"regexp_extract(url, '^https?://[^/]+')"
NO_FRAGMENT = r"regexp_replace(url, '#.*$', '')"

PAGE_LINKS = rf"""
page_hrefs as (
  select page_id, url as src_url, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) as href from pages
), page_links as (
  select distinct page_id, src_url, regexp_extract(src_url, '^https?://[^/]+') || {unescape('href')} as url from page_hrefs
)"""

PAGE_STATS = r"""
page_stats as (
  select url,
    len(regexp_extract_all(html, '<a[\s>]'))::bigint as links,
    len(regexp_extract_all(html, '<img[\s>]'))::bigint as images,
    len(regexp_extract_all(html, '<iframe[\s>]'))::bigint as iframes,
    len(regexp_extract_all(html, '<p[\s>]'))::bigint as paragraphs,
    len(regexp_extract_all(html, '<table[\s>]'))::bigint as tables,
    0::bigint as table_rows
  from pages
)"""

# ---- rendered pages ----

CATALOGUE = f"""
catalogue as (
  select c_custkey as k, '{SITE}/list/' || c_custkey as url, (c_custkey + 2) % 5 + 1 as n_rows from customer
)"""
CATALOGUE_STATS = """
catalogue_stats as (
  select url, 4 + (k % 2 = 0)::bigint as links, 0::bigint as images, 1::bigint as iframes,
    51 + k % 25 as paragraphs, 1::bigint as tables, n_rows as table_rows
  from catalogue
)"""
STATS = f"""{PAGE_STATS}, {CATALOGUE}, {CATALOGUE_STATS}, stats as (
  select * from page_stats union all select * from catalogue_stats
)"""
RULES = f"""{STATS}, rules as (
  select url, r.name, r.passed, r.weight::bigint as weight
  from stats, lateral (values
    ('link_heavy', links > 50 and iframes <= 0, 2),
    ('text_heavy', paragraphs > 50 and images <= 5, 2),
    ('table_catalogue', tables >= 1 and table_rows >= 3, 3),
    ('fallback_links', links > 30 and images <= 5, 1)
  ) r(name, passed, weight)
)"""
CATALOGUE_LINKS = f"""
catalogue_links as (
  select k as page_id, url as src_url, '{SITE}/list/' || (3 * k + i) as url, true as is_primary
  from catalogue, range(1, 4) t(i)
  union all
  select k, url, url || '?page=2', false from catalogue where k % 2 = 0
)"""

CARDS = f"""
cards as (
  select c_custkey as k, i, c_name || ' card ' || i as heading,
    case when (c_custkey + i) % 5 = 0 then 'Please login ' else '' end as notice,
    repeat('word ', ((c_custkey + i * 7) % 17 + 3)::int) as words,
    (c_custkey + i) % 7 <> 0 as has_image
  from customer, range(1, 9) t(i) where i <= c_custkey % 6 + 3
), blocks as (
  select *, length(heading) + length(rtrim(notice || words)) as text_length from cards where has_image
), ranked as (
  select *, row_number() over (partition by k order by text_length desc, i) as rank
  from blocks where notice = '' and text_length > 30
)"""

DETAIL = f"""
detail as (
  select p_partkey as k, '{SITE}/movie/' || p_partkey as url, p_partkey % 2 = 0 as framed, p_name, p_brand, p_type,
    (1950 + p_size)::varchar as year
  from part
)"""

MIXED = f"""{DETAIL}, {CATALOGUE}, {CARDS}, processed as (
  select url, case when framed then 'unknown' else 'detail' end as page_type, false as from_block, 0::bigint as n_links,
    0::bigint as n_rejected, null as next_page, case when not framed then {clean('p_name')} end as title,
    case when not framed then year end as year, case when not framed then {clean("'Director: ' || p_brand")} end as director,
    case when not framed then {clean("'Genre: ' || p_type")} end as genre,
    case when not framed then '/img/' || k || '.jpg' end as poster_url, null::varchar as streaming_link
  from detail
  union all
  select url, case when n_rows >= 3 then 'catalogue' else 'unknown' end, false,
    case when n_rows >= 3 then 3 + (k % 2 = 0)::bigint else 0 end, (n_rows >= 3)::bigint,
    case when n_rows >= 3 and k % 2 = 0 then '/list/' || k || '?page=2' end, null, null, null, null, null, null
  from catalogue
  union all
  select '{SITE}/blocks/' || c_custkey, case when r.k is null then 'unknown' else 'detail' end, r.k is not null, 0, 0,
    null, {clean('heading')}, null, null, null, null, null
  from customer left join ranked r on r.k = c_custkey and r.rank = 1
)"""
# the left join gives a NULL heading for pages without a block; cleaning turns NULL into ''
MIXED = MIXED.replace(f"null, {clean('heading')},", f"null, nullif({clean('heading')}, ''),")

TABLE_ROWS = """
table_rows as (
  select o_orderkey as page_id, o_orderpriority || ' part ' || i as title, (year(o_orderdate) + i)::varchar as year,
    o_orderstatus as genre, i
  from orders, range(1, 6) t(i) where i <= o_orderkey % 4 + 2
)"""

ITEMS = f"""
items as (
  select c_custkey as k, c_name as title, 1790 + c_custkey % 300 as y,
    case when c_custkey % 10 <> 0 then 'Director ' || c_custkey end as director,
    c_mktsegment || '|' || c_name as cast_names, c_mktsegment as genre,
    case c_custkey % 4 when 2 then repeat('A', (c_custkey % 2 + 1000 + c_custkey % 3)::int)
      when 3 then 'Story ' || c_custkey end as synopsis,
    c_custkey % 10 = 0 as no_director,
    1790 + c_custkey % 300 not between 1800 and 2030 as bad_year,
    (c_custkey % 4 = 1 and c_custkey % 3 = 0) or (c_custkey % 4 = 2 and c_custkey % 3 > 0) as bad_synopsis,
    c_custkey % 5 in (1, 2, 3) as bad_poster, c_custkey % 3 = 0 as bad_stream
  from customer
), checked as (
  select *, concat_ws(',', case when bad_year then 'year' end, case when no_director then 'director' end,
    case when bad_synopsis then 'synopsis' end, case when bad_poster then 'poster_url' end,
    case when bad_stream then 'streaming_link' end) as errors,
    concat_ws(',', case when bad_year then 'year' end, case when bad_synopsis then 'synopsis' end,
    case when bad_poster then 'poster_url' end, case when bad_stream then 'streaming_link' end) as partial_errors
  from items
)"""

LOCAL = """
local_rec as (
  select o_orderkey as k, case when o_orderkey % 6 <> 5 then (o_orderkey + case when o_orderkey % 3 = 0 then 1000000000 else 0 end)::varchar end as id,
    case when o_orderkey % 2 = 0 then 'Local ' || o_orderkey end as title,
    case when o_orderkey % 7 <> 0 then 'PART' || (o_orderkey % 1000) end as component,
    case when o_orderkey % 5 <> 1 then 'Impact: ' || o_orderpriority end as impact,
    case o_orderkey % 4 when 1 then 'open' when 2 then 'done' end as status,
    case when o_orderkey % 11 = 0 then 'P9' end as priority
  from orders
)"""
REMOTE = """
remote_rec as (
  select o_orderkey + case when o_orderkey % 3 = 1 then 2000000000 else 0 end as k, o_orderkey as o, 'Remote ' || o_orderkey as title,
    case when o_orderstatus = 'F' then 'closed' else 'open' end as state,
    case when o_orderkey % 32 = 0 then 'Text' || chr(10) || '```yaml' || chr(10) || '- component: list' || chr(10) || '```' || chr(10)
      when o_orderkey % 8 = 0 then 'Text' || chr(10) || '```yaml' || chr(10) || 'component: Part' || (o_orderkey % 1000) || chr(10)
        || 'nested:' || chr(10) || '  component: deep' || chr(10) || 'list:' || chr(10) || '- x' || chr(10)
        || 'priority: P' || (o_orderkey % 3) || ' # note' || chr(10) || 'owner: null' || chr(10) || '```' || chr(10) || 'end'
      when o_orderkey % 4 = 0 then 'Text' || chr(10) || '```yaml' || chr(10) || 'component: Part' || (o_orderkey % 1000) || chr(10)
        || 'priority: P' || (o_orderkey % 3) || chr(10) || 'owner: ''team ' || (o_orderkey % 7) || chr(39) || chr(10) || '```' || chr(10) || 'end'
      when o_orderkey % 5 <> 0 then 'Plain ' || o_orderkey else '' end as body,
    o_orderkey % 4 = 0 and o_orderkey % 32 <> 0 as has_block,
    'Part' || (o_orderkey % 1000) as component, 'P' || (o_orderkey % 3) as priority,
    case when o_orderkey % 8 <> 0 then 'team ' || (o_orderkey % 7) end as owner,
    'keep-this,k' || (o_orderkey % 10) as labels, o_orderkey % 50 = 0 as is_pull
  from orders
), remote_issue as (select * from remote_rec where not is_pull)"""
PROJECT = """
project_rec as (
  select o_orderkey + case when o_orderkey % 5 <> 0 then 3000000000 else 0 end as k, 'Remote ' || o_orderkey as title,
    case when o_orderkey % 15 <> 0 then 'Body ' || o_orderkey else '[no description]' end as description,
    case when o_orderkey % 25 <> 0 then 'closed' else 'open' end as status,
    case when o_orderkey % 4 = 3 then 'P0' else 'P' || (o_orderkey % 4) end as priority,
    case when o_orderkey % 2 = 1 then 'Sprint ' || (o_orderkey % 9) end as sprint,
    case when o_orderkey % 3 <> 0 then case when o_orderkey % 2 = 0 then 'XS' else 'L' end end as size
  from orders where o_orderkey % 20 <> 0
)"""
PULLED = f"""{LOCAL}, {REMOTE}, {PROJECT}, both_rec as (
  select coalesce(l.id, r.k::varchar) as id, l.k as lk, r.k as rk, l.title as l_title, l.component as l_component,
    l.impact, l.status as l_status, l.priority as l_priority, r.title as r_title, r.state, r.body, r.has_block,
    r.component as r_component, r.priority as r_priority, r.owner
  from local_rec l full join remote_issue r on l.id = r.k::varchar
), pulled as (
  select b.id,
    case when lk is null then 'added' when rk is null then 'kept' else 'updated' end as change,
    lk is not null and rk is not null and coalesce(l_status, 'open') <> state as status_changed,
    b.id as github_issue,
    case when rk is null then l_title else r_title end as title,
    case when rk is not null then coalesce(nullif(body, ''), '[no description]') end as description,
    case when rk is null then l_status when lk is null then state
      when coalesce(l_status, 'open') <> state then state else l_status end as status,
    case when rk is null then l_priority when has_block then r_priority else coalesce(p.priority, l_priority) end as priority,
    case when rk is not null then p.size end as size,
    case when rk is not null then p.sprint end as sprint,
    case when rk is not null and has_block then r_component else l_component end as component,
    impact, case when rk is not null and has_block then b.owner end as owner
  from both_rec b left join project_rec p on p.k = rk
)"""
PLAN = f"""{LOCAL}, {REMOTE}, by_component as (
  select lower(component) as ck, arg_min(k, o) as k, arg_min(labels, o) as labels from remote_issue where has_block group by 1
), plan as (
  select l.k as pos, case when l.component is null then 'skip' when r.k is not null or c.k is not null then 'update' else 'create' end as action,
    coalesce(r.k, c.k) as found, coalesce(r.labels, c.labels) as found_labels,
    coalesce(l.title, '[' || l.component || '] ' || coalesce(l.impact, 'Issue')) as full_title,
    '```yaml' || chr(10) || coalesce('component: ' || l.component || chr(10), '') || coalesce('impact: "' || l.impact || '"' || chr(10), '')
      || coalesce('priority: ' || l.priority || chr(10), '') || coalesce('status: ' || l.status || chr(10), '') || '```' as dump,
    l.status
  from local_rec l left join remote_issue r on r.k::varchar = l.id left join by_component c on c.ck = lower(l.component)
)"""


def _labels_table() -> str:
    rows = [
        f"('{field}', {i}, '{label}')" for i, (field, labels) in enumerate(LABELS) for label in labels
    ]
    return f"labels_dim(field, field_order, label) as (values {', '.join(rows)})"


def _normal(x: str) -> str:
    return rf"trim(regexp_replace(lower({x}), '[^\p{{L}}\p{{M}}\p{{N}}]+', ' ', 'g'))"


def _sorted(x: str) -> str:
    return f"array_to_string(list_sort(string_split({x}, ' ')), ' ')"


def _best(texts: str) -> str:
    """CTEs that end in ``best``: the field and score of each of ``texts`` (``text``)."""
    return rf"""
{_labels_table()}, texts as ({texts}), t as (select distinct text, {_normal('text')} as n from texts
), l as (select field, field_order, {_normal('label')} as m from labels_dim
), scored as (
  select text, field, field_order,
    max(round(greatest(
      100.0::double * (1.0::double - levenshtein(n, m) / greatest(length(n), length(m))),
      0.95::double * (100.0::double * (1.0::double - levenshtein({_sorted('n')}, {_sorted('m')}) / greatest(length(n), length(m)))),
      case when contains(' ' || n || ' ', ' ' || m || ' ') or (contains(n, m) and ascii(m) > 1000)
        then case when length(n) <= 8 * length(m) then 90.0::double else 60.0::double end else 0.0::double end))::bigint) as score
  from t, l where n <> '' group by all
), best as (
  select text, field, score from scored where score >= 70
  qualify row_number() over (partition by text order by score desc, field_order) = 1
)"""


MATCHED = f"""with {_best("""
  select p_partkey as key, i::bigint as shape, case i when 0 then 'Title' when 1 then 'Film Titles' when 2 then 'Release Yaer'
    when 3 then 'Running Time: ' || p_size when 4 then 'year release' when 5 then p_name when 6 then 'Genre - ' || p_type
    when 7 then 'Actors ' || p_name when 8 then p_brand || ' Directd by'
    else 'He was cast away near ' || p_name || ' for seventeen long years' end as text
  from part, range(10) t(i)""")}
select key, shape, text, field, coalesce(score, 0)::bigint as score from texts left join best using (text)"""


def _classes(expr_pages: str, mode: str) -> str:
    gate = "not (iframes >= 1 and links < 30)"
    if mode == "intended":
        kind = f"case when {gate} and score >= 4 then 'catalogue' when not ({gate}) then 'detail' else 'unknown' end"
    else:
        kind = f"case when not ({gate}) and score >= 4 then 'catalogue' when {gate} then 'detail' else 'unknown' end"
    return f"""
with {PAGE_STATS}, {CATALOGUE}, {CATALOGUE_STATS}, all_stats as (
  {expr_pages}
), scores as (
  select *, 2 * (links > 50 and iframes <= 0)::bigint + 2 * (paragraphs > 50 and images <= 5)::bigint
    + 3 * (tables >= 1 and table_rows >= 3)::bigint + (links > 30 and images <= 5)::bigint as score
  from all_stats
)
select url, score, {kind} as page_type from scores"""


MIXED_STATS = f"""select * from catalogue_stats
  union all select '{SITE}/movie/' || p_partkey, 0, 1, (p_partkey % 2 = 0)::bigint, 2, 0, 0 from part
  union all select '{SITE}/blocks/' || c_custkey, c_custkey % 6 + 3,
    (select count(*) from range(1, 9) t(i) where i <= c_custkey % 6 + 3 and (c_custkey + i) % 7 <> 0),
    1, c_custkey % 6 + 3, 0, 0 from customer"""
ALL_STATS = f"select * from page_stats union all {MIXED_STATS}"

BASE_PATH = r"regexp_extract(url, '^https?://[^/]+([^?#]*)', 1)"
FOLDER = rf"regexp_replace({BASE_PATH}, '[^/]*$', '')"

SOURCED_ROWS = f"""
sourced as (
  select p_partkey as item_id, case when p_partkey % 19 <> 0 then p_type || ', ' || p_name end as title,
    case when p_partkey % 17 <> 0 then (p_size + 1950)::varchar end as year, case when p_partkey % 3 <> 0 then p_brand end as director,
    case when p_partkey % 5 <> 0 then 'kind ' || (p_partkey % 4) end as genre,
    case when p_partkey % 11 <> 0 then '{SITE}/movie/' || p_partkey end as source_url, p_partkey % 10 as trust
  from part
)"""
SOURCED = f"""{SOURCED_ROWS}, keyed as (
  select *, trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) as title_key from sourced where title is not null and year is not null
)"""
# two sources; every title and year once; all pairs of neighbouring years scored
LINKED = f"""{SOURCED_ROWS}, both_sources as (
  select * from sourced union all
  select p_partkey + 1000000000, p_name || ' ' || left(p_type, (p_partkey % (length(p_type) - 1) + 1)::int) || substr(p_type, (p_partkey % (length(p_type) - 1) + 3)::int),
    (p_size + 1950)::varchar, case when p_partkey % 4 <> 0 then p_brand end, 'drama', '{SITE}/film/' || p_partkey, p_partkey % 7
  from part where p_partkey % 2 = 0
), keyed as (
  select *, trust * 10000000000000 - item_id as place, trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) as title_key
  from both_sources where title is not null and year is not null
), grouped as (
  select title_key, year::int as year, min(item_id) as node, arg_max(director, place) as director from keyed group by title_key, year
), nodes as (
  select *, list_distinct(flatten(list_transform(string_split(title_key, ' '),
    lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('_' || w || '_', i, 2))))) as pairs from grouped
), met as (
  select a.node as a, b.node as b, len(list_intersect(a.pairs, b.pairs)) as shared, len(a.pairs) + len(b.pairs) as held,
    a.year <> b.year as off, a.director as d, b.director as e
  from nodes a join nodes b on a.node < b.node and a.year - b.year between -1 and 1
), scored as (
  select a, b, 10 * ((100 * shared) // (held - shared)) + case when d = e then 50 when d <> e then -200 else 0 end
    + case when off then -310 else 0 end as points from met
), links as (select a, b, points::bigint as points from scored where points >= 700)"""
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"

ORACLES: dict[str, str] = {
    "page_scan": "select page_id, url, length(html)::bigint as n_chars from pages",
    "snapshot_lookup": "select url as request_url, md5(url) as key, page_id from pages",
    "missing_snapshots": f"""with {PAGE_LINKS}
        select distinct url, md5(url) as key from page_links where url not in (select url from pages)""",
    "tag_counts": r"""select page_id, tag, count(*)::bigint as n from (
        select page_id, unnest(regexp_extract_all(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'),
          '(?s)(<script[^>]*>).*?</script>', '\1', 'g'), '<([a-z][a-z0-9]*)[\s>]', 1)) as tag from pages) group by 1, 2""",
    "parse_failures": f"""select c_custkey as page_id, '{SITE}/list/' || c_custkey as url, 'no markup' as error
        from customer where c_custkey % 4 = 0""",
    "failed_pages": f"""select c_custkey as page_id, '{SITE}/list/' || c_custkey as url, null::varchar as page_type, false as has_item,
        'no markup' as error from customer where c_custkey % 4 = 0""",
    "label_table": """select l.field, 70::bigint as threshold, l.n_labels::bigint as n_labels,
        case l.field when 'title' then n when 'year' then n when 'director' then n when 'genre' then n else 0 end::bigint as n_pages
        from (values ('title', 6), ('year', 6), ('director', 5), ('genre', 5), ('duration', 6), ('cast', 5)) l(field, n_labels),
        (select count(*) as n from part)""",
    "seed_pages": f"""select url, c_custkey as page_id from (values (1), (2), (3), (-1)) s(k),
        lateral (select case when k < 0 then '{SITE}/nowhere' else '{SITE}/list/' || k end as url) left join customer on c_custkey = k""",
    "written_errors": f"""select 'r1' as run_ts, '{SITE}/list/' || c_custkey as url, 'no markup' as error from customer where c_custkey % 4 = 0""",
    "written_summary": """select 'r1' as run_ts, 'films' as spider_name, 9.0::double as runtime_seconds, 0::bigint as items_scraped,
        count(*) filter (c_custkey % 4 = 0)::bigint as errors from customer""",
    "own_text": """select p_partkey as page_id, i::int as pos,
        case i when 0 then 'Director: ' || p_brand else 'Genre: ' || p_type end as text from part, range(2) t(i)""",
    "heading_text": f"select page_id, {unescape('regexp_extract(html, $$<h1>(.*?)</h1>$$, 1)')} as heading from pages",
    "cell_text": f"""with {TABLE_ROWS}, numbered as (select *, page_id % 3 = 2 as lead from table_rows)
        select page_id, title as cell from numbered union all select page_id, year from numbered
        union all select page_id, genre from numbered union all select page_id, i::varchar from numbered where lead""",
    "selector_counts": r"""select page_id,
        len(regexp_extract_all(regexp_extract(html, '(?s)<nav>.*?</nav>'), '<a '))::bigint as nav_links,
        len(regexp_extract_all(html, '<div class="ad"'))::bigint as ad_blocks,
        len(regexp_extract_all(html, 'class="[^"]*a'))::bigint as ad_like,
        len(regexp_extract_all(regexp_extract(html, '(?s)<article>.*?</article>'), '<h1>'))::bigint as article_headings,
        len(regexp_extract_all(html, ' lang="'))::bigint as with_lang,
        len(regexp_extract_all(html, '<ul>\s*<li>'))::bigint as first_items,
        len(regexp_extract_all(html, '<(h1|li)>'))::bigint as headings_or_items from pages""",
    "raw_links": f"""with {PAGE_LINKS} select page_id, {unescape('href')} as href from page_hrefs""",
    "field_by_selector": f"""select page_id,
        {strip(unescape("regexp_extract(html, '<div class=' || chr(34) || 'ad' || chr(34) || '>([^<]*)', 1)"))} as value from pages""",
    "cleaned_texts": f"select doc_id, {clean('text')} as cleaned from documents",
    "stripped_texts_of_documents": f"select doc_id, {strip('text')} as stripped from documents",
    "paragraph_lengths": f"""with lines as (select doc_id, unnest(string_split(text, chr(10))) as line from documents)
        select doc_id, count(*)::bigint as n_paragraphs from lines where length({strip('line')}) between 5 and 200 group by doc_id""",
    "blacklisted_texts": """select doc_id, contains(lower(text), 'login') or contains(lower(text), 'subscribe')
        or contains(lower(text), 'advertisement') or contains(lower(text), 'sponsored') or contains(lower(text), 'cookie') as is_junk
        from documents""",
    "page_stats": f"with {STATS} select * from stats",
    "page_rules": f"with {RULES} select url, name, passed, weight from rules",
    "page_scores": f"""with {RULES} select url, coalesce(sum(weight) filter (passed), 0)::bigint as score_sum,
        coalesce(sum(weight) filter (passed), 0)::double / sum(weight)::double * 100.0 as score_average,
        count(*) filter (passed) > count(*) / 2.0 as score_majority from rules group by url""",
    "detail_like_pages": f"""with {CATALOGUE}, {CATALOGUE_STATS}, s as ({MIXED_STATS})
        select url, not (iframes >= 1 and links < 30) as is_detail_like from s""",
    "classify_as_coded": _classes(ALL_STATS, "as_coded"),
    "classify_intended": _classes(ALL_STATS, "intended"),
    "classify_own_rules": f"""with {PAGE_STATS}, s as (
        select url, 3 * (links >= 6)::bigint + 2 * (paragraphs <= 3)::bigint as score from page_stats)
        select page_id, score, case when score >= 3 then 'catalogue' else 'unknown' end as page_type from s join pages using (url)""",
    "resolved_urls": rf"""with c as (
        select page_id, url as u, regexp_extract(url, '^https?') as scheme, {ORIGIN} as origin, {FOLDER} as folder,
          {NO_FRAGMENT} as page from pages)
        select page_id,
          case page_id % 12 when 0 then origin || '/a/' || page_id when 1 then origin || folder || 'b/' || page_id
            when 2 then origin || regexp_replace(folder, '[^/]+/$', '') || 'c/' || page_id
            when 3 then scheme || '://host' || page_id || '.example.com/p' when 4 then page when 5 then page
            when 6 then 'mailto:m' || page_id || '@example.com' when 7 then 'JavaScript:void(0)' when 8 then 'tel:' || page_id
            when 9 then 'ftp://example.com/' || page_id when 10 then origin || folder || 'None'
            else 'https://example.com/x/../y' || page_id || '?q=1' end as url,
          case when page_id % 12 in (6, 7, 8) then 'Non-crawlable scheme'
            when page_id % 12 = 9 then 'Unsupported or malformed URL format'
            when page_id % 12 = 10 then 'Empty or None' end as reason from c""",
    "link_reasons": """select page_id, case page_id % 12 when 3 then null when 4 then 'Fragment-only link or base URL'
          when 5 then 'Empty or None' when 6 then 'Non-crawlable scheme' when 7 then 'Non-crawlable scheme'
          when 8 then 'Non-crawlable scheme' when 9 then 'Unsupported or malformed URL format' when 10 then 'Empty or None'
        end as reason from pages""",
    "extracted_links": f"""with {PAGE_LINKS}, {CATALOGUE}, {CATALOGUE_LINKS}
        select src_url, url, false as is_primary from page_links
        union all select src_url, url, is_primary from catalogue_links""",
    "rejected_links": f"""with {CATALOGUE} select url as src_url, 'mailto:desk@example.com' as url, 'Non-crawlable scheme' as reason
        from catalogue""",
    "next_pages": "select c_custkey as page_id, case when c_custkey % 2 = 0 then '/list/' || c_custkey || '?page=2' end as next_page from customer",
    "unseen_links": f"""with {CATALOGUE}, {CATALOGUE_LINKS}
        select distinct url from catalogue_links where url not in (select url from catalogue)""",
    "links_in_domains": f"""with {PAGE_LINKS}, hosts as (select *, regexp_extract(url, '^https?://([^/]+)', 1) as host from page_links)
        select page_id, url from hosts where host = 'example.net' or ends_with(host, '.example.net')
        or host = 'blog.tiontion.example.com' or ends_with(host, '.blog.tiontion.example.com')""",
    "link_graph": f"""with {CATALOGUE}, {CATALOGUE_LINKS}
        select page_id as src_page_id, c.k as dst_page_id, c.url from catalogue_links l join catalogue c on c.url = l.url""",
    "frontier_order": f"""with {CATALOGUE}, {CATALOGUE_LINKS}, found as (
        select url, (case when is_primary then 10 else 5 end)::int as priority, page_id as pos from catalogue_links)
        select url, priority, pos from found where url not in (select url from catalogue)
        qualify row_number() over (partition by url order by priority desc, pos) = 1""",
    "crawl": f"""with recursive {CATALOGUE}, {CATALOGUE_LINKS}, walk as (
          select '{SITE}/list/0' as url, 0 as depth, 0 as priority
          union all
          select l.url, w.depth + 1, 10
          from walk w join catalogue c on c.url = w.url and c.n_rows >= 3 join catalogue_links l on l.page_id = c.k)
        select w.url, w.depth, w.priority, case when c.k is not null then case when c.n_rows >= 3 then 'catalogue' else 'unknown' end end as page_type
        from walk w left join catalogue c on c.url = w.url""",
    "matched_labels": MATCHED,
    "main_fields": f"""with {DETAIL} select k as page_id, {clean('p_name')} as title, year, '/img/' || k || '.jpg' as poster_url,
        case when framed then '//stream.example.com/' || k end as streaming_link from detail""",
    "main_fields_whole_urls": f"""with {DETAIL} select k as page_id, {clean('p_name')} as title, year, '/img/' || k || '.jpg' as poster_url,
        case when framed then 'https://stream.example.com/' || k end as streaming_link from detail""",
    "paragraph_fields": """select p_partkey as page_id, null::varchar as title, null::varchar as year, p_brand as director, p_type as genre,
        null::varchar as duration, null::varchar as "cast" from part""",
    "paragraph_fields_prose": f"""with {_best(f"select doc_id, i, {strip('line')} as text from (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as i from documents) where length({strip('line')}) between 5 and 200")},
        hits as (select doc_id, i, field, {clean('text')} as value from texts join best using (text)),
        firsts as (select doc_id, field, arg_min(value, i) as value from hits group by 1, 2)
        select d.doc_id as page_id, max(value) filter (field = 'title') as title, max(value) filter (field = 'year') as year,
          max(value) filter (field = 'director') as director, max(value) filter (field = 'genre') as genre,
          max(value) filter (field = 'duration') as duration, max(value) filter (field = 'cast') as "cast"
        from documents d left join firsts f using (doc_id) group by 1""",
    "paragraph_fields_games": "select p_partkey as page_id, p_type as genre, null::varchar as developer, null::varchar as platform from part",
    "merged_fields": f"""with {DETAIL} select page_id, field, value from (
        select k as page_id, 'title' as field, {clean('p_name')} as value from detail union all select k, 'year', year from detail
        union all select k, 'poster_url', '/img/' || k || '.jpg' from detail union all select k, 'director', p_brand from detail
        union all select k, 'genre', p_type from detail
        union all select k, 'streaming_link', '//stream.example.com/' || k from detail where framed)""",
    "table_items": f"with {TABLE_ROWS} select page_id, title, year, genre, null::varchar as director from table_rows",
    "table_item_counts": "select o_orderkey as page_id, o_orderkey % 4 + 2 as n_items from orders",
    "header_fields": """select h.header, h.field, count(*)::bigint as n_tables from orders,
        (values ('Title', 'title'), ('Release Year', 'year'), ('Genre', 'genre'), ('Random', null)) h(header, field)
        where h.header <> 'Random' or o_orderkey % 3 = 2 group by 1, 2""",
    "table_rows_per_page": """select o_orderkey as page_id, 1::bigint as tables,
        o_orderkey % 4 + 2 + (o_orderkey % 3 = 1)::bigint as table_rows from orders""",
    "candidate_blocks": f"""with {CARDS} select k as page_id, rank, text_length,
        '<div class="card"><a href="/card/' || i || '"><img src="/c/' || i || '.jpg"></a><h1 class="title">' || heading
          || '</h1><p>' || words || '</p></div>' as snippet from ranked where rank <= 5""",
    "evident_blocks": """with cards as (
        select p_partkey as k, i, case when (p_partkey + i) % 3 <> 0 then p_name || ' ' || i else '' end as heading, repeat('word ', (i + 10)::int) as words,
          case when (p_partkey + i) % 2 = 0 then (p_size + 1950)::varchar else '' end as year,
          case when (p_partkey + i) % 5 < 2 then 'Director: ' || p_brand else '' end as director
        from part, range(1, 7) t(i) where i <= p_partkey % 4 + 3),
        good as (select *, length(heading) + length(rtrim(words)) + length(year) + length(director) as text_length from cards
          where (heading <> '')::int + (year <> '')::int + (director <> '')::int >= 2),
        ranked as (select *, row_number() over (partition by k order by text_length desc, i) as rank from good)
        select k as page_id, rank, text_length, '<div class="card"><a href="/card/' || i || '"><img src="/c/' || i || '.jpg"></a>'
          || case when heading <> '' then '<h2>' || heading || '</h2>' else '' end || '<p>' || words
          || case when year <> '' then '<span>' || year || '</span>' else '' end
          || case when director <> '' then '<b>' || director || '</b>' else '' end || '</p></div>' as snippet
        from ranked where rank <= 5""",
    "block_features": f"""with {CARDS} select k as page_id, lower(heading || rtrim(notice || words)) as text from blocks""",
    "best_blocks": f"with {CARDS} select k as page_id, rank, text_length + 1 as score from ranked where rank = 1",
    "extracted_everything": f"""with {DETAIL}, {CATALOGUE}, {CARDS}
        select url, 0::bigint as n_links, 3 + framed::bigint as n_main_fields, 2::bigint as n_paragraph_fields, 0::bigint as n_items,
          {clean('p_name')} as title, p_brand as director from detail
        union all select url, 3 + (k % 2 = 0)::bigint, 1, 0, 0, null, null from catalogue
        union all select '{SITE}/blocks/' || c_custkey, c_custkey % 6 + 3, 2, 0, 0, c_name || ' card 1', null from customer
        union all select '{SITE}/order/' || o_orderkey, 0, 0, 0, o_orderkey % 4 + 2, null, null from orders""",
    "processed_pages": f"with {MIXED} select * from processed",
    "processed_stored_pages": "select page_id, 'detail' as page_type, 0::bigint as n_fields, null::varchar as error from pages",
    "checked_items": f"""with {ITEMS} select k as item_id, title, y as year, director, cast_names, genre, synopsis, errors from checked""",
    "checked_items_partial": f"with {ITEMS} select k as item_id, partial_errors as errors from checked where partial_errors <> ''",
    "dropped_by_reason": f"""with {ITEMS} select reason, count(*)::bigint as n_items
        from (select unnest(string_split(errors, ',')) as reason from checked where errors <> '') group by 1""",
    "run_counters": f"""with {MIXED} select count(*)::bigint as pages, count(*) filter (page_type = 'detail')::bigint as items_scraped,
        sum(n_rejected)::bigint as invalid_links, 0::bigint as errors from processed""",
    "run_summary": f"""with {MIXED} select 'films' as spider_name, 90.5::double as runtime_seconds,
        count(*) filter (page_type = 'detail')::bigint as items_scraped, 0::bigint as errors, 1::bigint as n_warnings,
        'finished' as close_reason from processed""",
    "written_items": f"""with {ITEMS} select 'r1' as run_ts, k as item_id, title, y as year, director from checked where partial_errors = ''""",
    "written_rejects": f"""with {CATALOGUE} select k as page_id, 'Non-crawlable scheme' as reason, 'mailto:desk@example.com' as url
        from catalogue where n_rows >= 3""",
    "streamed_pages": "select page_id, 'detail' as page_type, 0::bigint as n_fields, null::varchar as error from pages",
    "streamed_batches": f"""with classed as ({_classes('select * from page_stats', 'as_coded')})
        select page_id, page_type, 1 + (page_id % 3 = 0)::bigint as n_seen from classed join pages using (url)""",
    "streamed_counts": f"""with classed as ({_classes('select * from page_stats', 'intended')})
        select page_type, sum(1 + (page_id % 3 = 0)::bigint)::bigint as n from classed join pages using (url) group by 1""",
    "local_records": f"""with {LOCAL} select k as pos, id, field, value from (
        select k, id, 'github_issue' as field, id as value from local_rec union all select k, id, 'title', title from local_rec
        union all select k, id, 'component', component from local_rec union all select k, id, 'impact', impact from local_rec
        union all select k, id, 'status', status from local_rec union all select k, id, 'priority', priority from local_rec)
        where value is not null""",
    "remote_records": f"""with {REMOTE} select k as number, title, state, labels from remote_issue
        union all select k, 'Old ' || o, 'open', 'stale' from remote_issue where o % 13 = 0""",
    "skipped_pull_requests": f"with {REMOTE} select count(*)::bigint as skipped from remote_rec where is_pull",
    "embedded_blocks": f"""with {REMOTE} select k as number, field, value from (
        select k, 'component' as field, component as value from remote_issue where has_block
        union all select k, 'priority', priority from remote_issue where has_block
        union all select k, 'owner', owner from remote_issue where has_block) where value is not null""",
    "project_records": f"""with {PROJECT} select k::varchar as id, title, description, status, priority, sprint, size from project_rec""",
    "pulled_records": f"with {PULLED} select * from pulled",
    "pull_summary": f"""with {PULLED} select count(*) filter (change = 'added')::bigint as added,
        count(*) filter (change = 'updated')::bigint as updated, count(*) filter (status_changed)::bigint as status_changed from pulled""",
    "saved_records": f"""with {PULLED} select id, title, description, status, priority, size, sprint, component, impact, owner from pulled""",
    "push_plan": f"""with {PLAN} select pos, action, case when action = 'update' then found end as number,
        case when action <> 'skip' then full_title end as title, case when action <> 'skip' then dump end as description,
        case when action = 'update' then case when lower(status) = 'done' then 'closed' else 'open' end end as state,
        case when action = 'update' then found_labels end as labels from plan""",
    "push_then_pull": f"""with {LOCAL} select k as pos, component, impact, status, priority from local_rec where component is not null""",
    "push_summary": f"""with {PLAN} select count(*) filter (action = 'create')::bigint as created,
        count(*) filter (action = 'update')::bigint as updated, count(*) filter (action = 'skip')::bigint as skipped from plan""",
    "merged_items": f"""with {SOURCED} select title_key, year,
        arg_max(title, trust * 1000000000000 - item_id) as title, arg_max(director, trust * 1000000000000 - item_id) as director,
        arg_max(genre, trust * 1000000000000 - item_id) as genre, count(*)::bigint as n_sources from keyed group by 1, 2""",
    "item_links": f"with {LINKED} select a, b, points from links",
    "linked_items": f"""with recursive {LINKED}, edges as (select a, b from links union all select b, a from links),
        reach as (select node as a, node as b from nodes union select r.a, e.b from reach r join edges e on r.b = e.a),
        films as (select a as node, min(b) as film from reach group by 1),
        named as (select k.*, film from keyed k join nodes n on k.title_key = n.title_key and k.year::int = n.year join films using (node))
        select film as item_id, arg_max(title, place) as title, arg_max(year, place) as year, arg_max(director, place) as director,
          arg_max(genre, place) as genre, count(*)::bigint as n_sources, count(distinct (title_key, year))::bigint as n_titles from named group by 1""",
    "field_provenance": f"""with {DETAIL}, long as (
        select k, url, 'title' as field, {clean('p_name')} as value from detail union all select k, url, 'year', year from detail
        union all select k, url, 'poster_url', '/img/' || k || '.jpg' from detail
        union all select k, url, 'streaming_link', '//stream.example.com/' || k from detail where framed)
        select k as page_id, field, value, url as source_url, 64::bigint as hash_length from long""",
    "enrichment_flags": f"""with {SOURCED} select item_id,
        title is not null and year is null and director is null and genre is null as title_only,
        title is null or year is null or director is null as enrichment_needed from sourced""",
    "retries": f"""select '{SITE}/movie/' || l_partkey as url, count(*)::bigint as attempts from lineitem where l_returnflag = 'R'
        group by 1 having count(*) < 12""",
    "capped_domains": """select host, page_id from (select regexp_extract(url, '^https?://([^/?#]*)', 1) as host, page_id from pages)
        qualify row_number() over (partition by host order by page_id) <= 5""",
    "item_quality": f"""with {SOURCED}, long as (select 'title' as field, title as v from sourced union all select 'year', year from sourced
        union all select 'director', director from sourced union all select 'genre', genre from sourced)
        select field, count(*)::bigint as n_rows, count(*) filter (v is null)::bigint as n_missing, min(length(v))::bigint as min_length,
          max(length(v))::bigint as max_length from long group by 1""",
    "item_kpis": f"""with {SOURCED} select count(*)::bigint as n_items,
        avg((title is not null and year is null and director is null and genre is null)::int::double) as title_only_ratio,
        avg((source_url is not null)::int::double) as provenance_coverage,
        avg(((title is not null)::int + (year is not null)::int + (director is not null)::int + (genre is not null)::int)::double) as avg_fields
        from sourced""",
    "page_drift": f"""select '{SITE}/movie/' || p_partkey as url, case when p_size = 11 then 'new' when p_size = 7 then 'gone'
        when p_size % 5 < 3 then 'changed' else 'same' end as status from part""",
    "scrubbed_texts": f"""select doc_id, regexp_replace(regexp_replace(text, '{EMAIL}', '[email]', 'g'),
        '(^|[^\\w.])\\+?\\d(?:[ ()./-]{{0,2}}\\d){{6,14}}\\b', '\\1[phone]', 'g') as text from documents""",
    "upserted_items": f"""with {SOURCED}, runs as (
        select title_key, year, item_id, title, director, genre, '2024-01-01' as first_seen, '2024-06-01' as last_seen, 0 as run from keyed
        union all select title_key, year, item_id, title, case when item_id % 3 = 0 then director end, case when item_id % 3 <> 0 then genre end,
          '2025-01-01', '2025-01-01', 1 from keyed)
        select title_key, year, arg_max(title, run * 1000000000000 - item_id) as title,
          arg_max(director, run * 1000000000000 - item_id) as director, arg_max(genre, run * 1000000000000 - item_id) as genre,
          min(first_seen) as first_seen, max(last_seen) as last_seen from runs group by 1, 2""",
    "item_history": f"""with {SOURCED}, steps as (
        select *, trust < 5 and genre is not null as renamed, trust = 7 and director is not null as lost from sourced),
        runs as (
          select item_id, title, year, director, genre, '2024-01-01' as valid_from, case when renamed then '2024-06-01' when lost then '2025-01-01' end as valid_to,
            '' as changed from steps
          union all select item_id, title, year, director, 'new ' || genre, '2024-06-01', '2025-01-01', 'genre' from steps where renamed
          union all select item_id, title, year, case when not lost then director end, genre, '2025-01-01', null,
            case when renamed then 'genre' else 'director' end from steps where renamed or lost)
        select * from runs""",
    "stored_item_history": f"""with {SOURCED}, lines as (
        select title_key, year, item_id, '2024-01-01' as seen, title, director, genre from keyed
        union all select title_key, year, item_id, '2024-06-01', title, director, case when trust < 5 then 'new ' || genre else genre end from keyed
        union all select title_key, year, item_id, '2025-01-01', title,
          case when trust = 7 then 'by ' || director when trust > 7 then director end, genre from keyed),
        runs as (select title_key, year, seen, arg_min(title, item_id) as title, arg_min(director, item_id) as director, arg_min(genre, item_id) as genre
          from lines group by all),
        held as (select title_key, year, seen, last_value(title ignore nulls) over w as title, last_value(director ignore nulls) over w as director,
          last_value(genre ignore nulls) over w as genre from runs window w as (partition by title_key, year order by seen)),
        steps as (select *, row_number() over w as n, concat_ws(',', case when title is distinct from lag(title) over w then 'title' end,
          case when director is distinct from lag(director) over w then 'director' end, case when genre is distinct from lag(genre) over w then 'genre' end) as differs
          from held window w as (partition by title_key, year order by seen))
        select title_key, year, title, director, genre, seen as valid_from, lead(seen) over (partition by title_key, year order by seen) as valid_to,
          case when n = 1 then '' else differs end as changed from steps where n = 1 or differs <> ''""",
    "upserted_all_items": f"""with {SOURCED}, runs as (
        select title_key, year, item_id, title, director, genre, '2024-01-01' as first_seen, '2024-06-01' as last_seen, 0 as run from keyed
        union all select title_key, year, item_id, title, case when trust < 5 then director end,
          case when trust < 5 then 'new ' || genre else genre end, '2025-01-01', '2025-01-01', 1 from keyed)
        select title_key, year, arg_max(title, run * 1000000000000 - item_id) as title,
          arg_max(director, run * 1000000000000 - item_id) as director, arg_max(genre, run * 1000000000000 - item_id) as genre,
          min(first_seen) as first_seen, max(last_seen) as last_seen from runs group by 1, 2""",
    "likely_items": f"""with {SOURCED} select item_id from sourced
        where (title is not null)::int + (year is not null)::int + (director is not null)::int >= 2""",
    "selector_ranking": """with n as (select (select count(*) from part) as parts, (select count(*) from customer) as customers,
          (select count(*) from part where p_partkey % 2 = 0) as framed),
        rates(field, selector, hits) as (
          select 'title', 0, parts from n union all select 'title', 1, customers from n union all select 'title', 2, 0 from n
          union all select 'year', 0, parts from n union all select 'year', 1, 0 from n union all select 'poster_url', 0, parts from n
          union all select 'streaming_link', 0, framed + 2 * customers from n)
        select field, selector::bigint as selector, hits::double / (parts + 2 * customers)::double as hit_rate,
          row_number() over (partition by field order by hits desc, selector)::bigint as rank from rates, n""",
    "title_search": f"""with {SOURCED} select item_id, title from sourced
        where list_has_all(string_split(replace(lower(title), ',', ''), ' '), ['widget', 'economy'])""",
    "exported_items": f"""with {SOURCED} select item_id, title, director from sourced where trust >= 5 and director is not null""",
}
ORACLES["field_selectors"] = f"select page_id, field, value, 0::bigint as selector from ({ORACLES['field_provenance']})"
ORACLES["crawl_kpis"] = f"""select k.*, (select median(depth) from (
    select url, min(depth) as depth from ({ORACLES["crawl"]}) where page_type is not null group by 1)) as median_depth
    from ({ORACLES["item_kpis"]}) k"""

ORACLES["store_round_trip"] = "select md5(url) as key, max(html) as html from pages where url is not null group by 1 having max(html) is not null"
ORACLES["store_requests"] = f"""select distinct '{SITE}/movie/' || p_partkey as url, length('<html><body><h1 class="entry-title"></h1><span class="ytps">'
    || '</span><div class="entry-content"><img src="/img/.jpg"><p>Director: </p><p>Genre: </p></div></body></html>')
    + length(p_name) + 4 + length(p_partkey::varchar) + length(p_brand) + length(p_type)
    + case when p_partkey % 2 = 0 then length('<iframe src="https://stream.example.com/"></iframe>') + length(p_partkey::varchar) else 0 end as size
    from part where p_partkey in (select l_partkey from lineitem)"""

FETCHES = f"""
fetches as (
  select '{SITE}/movie/' || l_partkey as url, l_shipdate as ts, case when l_returnflag = 'R' then 'HTTP ' || (l_linenumber + 500) end as error from lineitem
), queue as (
  select f.url, count(distinct row(ts, error))::bigint as attempts, min(ts) as first_failed, max(ts) as last_failed, arg_max(error, row(ts, error)) as last_error
  from fetches f left join (select url, max(ts) as well from fetches where error is null group by 1) w using (url)
  where error is not null and (well is null or ts > well) group by 1
), timed as (
  select *, last_failed + to_minutes(least(30 * power(2, least(attempts - 1, 20)), 10080)::bigint) as next_at from queue
)"""
ORACLES["retry_table"] = f"""with {FETCHES} select url, attempts, last_error, strftime(first_failed, '%Y-%m-%d %H:%M:%S') as first_failed,
    strftime(last_failed, '%Y-%m-%d %H:%M:%S') as last_failed, case when attempts < 4 then strftime(next_at, '%Y-%m-%d %H:%M:%S') end as next_at from timed"""
ORACLES["retries_due"] = f"with {FETCHES} select url from timed where attempts < 5 and next_at <= timestamp '2001-09-06'"
ORACLES["retry_rates"] = f"""with {FETCHES}, log as (select url, ts, case when count(*) = count(error) then max(error) end as error from fetches group by 1, 2),
    tries as (select *, lead(ts) over (partition by url order by ts) as next_try from log),
    urls as (select url, min(ts) filter (error is not null) as failed, max(ts) filter (error is null) as well,
      sum(epoch(next_try) - epoch(ts)) filter (error is not null) / 60 as delay, count(next_try) filter (error is not null) as n from tries group by 1)
    select count(*)::bigint as n_failed, avg(coalesce(well > failed, false)::int::double) as recovered_share, sum(delay) / sum(n) as avg_delay_minutes
    from urls where failed is not null"""
VALUE_REPORT = f"""{SOURCED}, long as (
  select 'title' as field, title as v, null as low, null as high from sourced union all select 'year', year, 1800, 1995 from sourced
  union all select 'director', director, null, null from sourced union all select 'genre', genre, null, null from sourced
  union all select 'trust', trust::varchar, 0, 8 from sourced
), report as (
  select field, count(*)::bigint as n_rows, count(*) filter (v is null)::bigint as n_missing,
    count(*) filter (v is null)::double / count(*) as missing_share, min(case when low is not null then try_cast(v as bigint) end) as smallest,
    max(case when low is not null then try_cast(v as bigint) end) as largest,
    case when max(low) is not null then count(*) filter (v is not null and try_cast(v as bigint) is null)::bigint end as n_not_whole,
    case when max(low) is not null then count(*) filter (try_cast(v as bigint) not between low and high)::bigint end as n_outside
  from long group by field
)"""
ORACLES["value_ranges"] = f"with {VALUE_REPORT} select * from report"
ORACLES["quality_alarms"] = f"""with {VALUE_REPORT}
    select field, 'missing' as reason, missing_share as share from report join (values ('title', 0.01), ('year', 0.5), ('genre', 0.1)) l(field, most) using (field)
    where missing_share > most
    union all select field, 'bad', (n_not_whole + n_outside)::double / (n_rows - n_missing) from report where (n_not_whole + n_outside)::double / (n_rows - n_missing) > 0.05"""
ORACLES["coverage_by_field"] = f"""with {SOURCED}, long as (select 'title' as field, title as v, source_url from sourced union all select 'year', year, source_url from sourced
    union all select 'director', director, source_url from sourced union all select 'genre', genre, source_url from sourced)
    select field, count(*)::bigint as n_values, count(source_url)::bigint as n_sourced, count(*)::bigint as n_pages, count(source_url)::double / count(*) as coverage
    from long where v is not null group by 1"""
ORACLES["merge_kpis"] = f"""with {SOURCED}, films as (
      select title_key, year, count(distinct source_url) as n_sources, arg_max(item_id, trust * 1000000000000 - item_id) as t,
        arg_max(item_id, trust * 1000000000000 - item_id) filter (director is not null) as d,
        arg_max(item_id, trust * 1000000000000 - item_id) filter (genre is not null) as g from keyed group by 1, 2),
      shares as (select *, coalesce(d <> t, false) or coalesce(g <> t, false) as merged, 2 + (d is not null)::int + (g is not null)::int as n_fields from films)
    select count(*)::bigint as n_films, avg(merged::int::double) as merged_entry_rate, avg(n_sources) as avg_sources,
      avg(n_fields) filter (merged) as avg_fields_per_merged_entry, count(*) filter (d is null or g is null)::bigint as enrichment_backlog from shares"""

ORACLES["tables_in_sql"] = ORACLES["table_items"]
ORACLES["links_in_sql"] = ORACLES["extracted_links"]

# rendered pages: the markup again for its hash, and each value at its place
ORACLES["value_origins"] = f"""with {DETAIL}, pages as (select *, sha256('<html><body><h1 class="entry-title">' || p_name || '</h1><span class="ytps">' || year
      || '</span><div class="entry-content"><img src="/img/' || k || '.jpg"><p>Director: ' || p_brand || '</p><p>Genre: ' || p_type || '</p></div>'
      || case when framed then '<iframe src="https://stream.example.com/' || k || '"></iframe>' else '' end || '</body></html>') as html_hash from detail),
    long as (
      select k, 'main' as extractor, 'title' as field, {clean('p_name')} as value, '/*[1]/text()[1]' as place from detail
      union all select k, 'main', 'year', year, '/*[2]/text()[1]' from detail
      union all select k, 'main', 'poster_url', '/img/' || k || '.jpg', '/*[3]/*[1]/@src' from detail
      union all select k, 'main', 'streaming_link', '//stream.example.com/' || k, '/*[4]/@src' from detail where framed
      union all select k, 'paragraph', 'director', p_brand, '/*[3]/*[2]/text()[1]' from detail
      union all select k, 'paragraph', 'genre', p_type, '/*[3]/*[3]/text()[1]' from detail)
    select k as page_id, extractor, field, value, case extractor when 'main' then 0::bigint end as selector, url as source_url, html_hash,
      case when place like '%@src' then 'attribute' else 'text' end as reading, '/*[1]/*[1]' || place as path from long join pages using (k)"""
ORACLES["cell_origins"] = f"""with {TABLE_ROWS}, cells as (
      select page_id, i, unnest([{{'f': 'title', 'v': title, 'c': 1}}, {{'f': 'year', 'v': year, 'c': 2}}, {{'f': 'genre', 'v': genre, 'c': 3}}], recursive := true)
      from table_rows)
    select page_id, 'table' as extractor, f as field, v as value, 'cell' as reading, case page_id % 3 when 0 then '/*[1]/*[2]/*[' || i || ']/*[' || c || ']'
      when 1 then '/*[1]/*[' || (i + 1) || ']/*[' || c || ']' else '/*[1]/*[2]/*[' || i || ']/*[' || (c + 1) || ']' end as path from cells"""
ORACLES["values_read_again"] = " union all ".join(
    f"select page_id, extractor, field, value, value as again from ({ORACLES[name]})" for name in ("value_origins", "cell_origins")
)

# every value of the nested blocks, in the columns they were rendered from
NESTED = """
nested as (
  select o_orderkey as k, year(o_orderdate) as y from orders where o_orderkey % 7 > 1
), nested_values as (
  select k as number, unnest([
    {'path': '$.component', 'value': 'Part' || (k % 1000), 'kind': 'str'},
    {'path': '$.release.year', 'value': y::varchar, 'kind': 'int'},
    {'path': '$.release.price', 'value': (k % 90) || '.5', 'kind': 'float'},
    {'path': '$.release.open', 'value': case when k % 2 = 0 then 'true' else 'false' end, 'kind': 'bool'},
    {'path': '$.people[0].name', 'value': 'team ' || (k % 7), 'kind': 'str'},
    {'path': '$.people[0].roles[0]', 'value': 'lead', 'kind': 'str'},
    {'path': '$.people[0].roles[1]', 'value': 'p' || (k % 3), 'kind': 'str'},
    {'path': '$.people[1].name', 'value': null, 'kind': 'null'},
    {'path': '$.notes', 'value': 'first ' || k || chr(10) || '# second' || chr(10), 'kind': 'str'},
    {'path': '$.empty', 'value': '{}', 'kind': 'dict'},
    {'path': '$.priority', 'value': 'P' || (k % 3), 'kind': 'str'}]) as v from nested
)"""
ORACLES["nested_blocks"] = f"with {NESTED} select number, v.path as path, v.value as value, v.kind as kind from nested_values"
ORACLES["nested_push_pull"] = ORACLES["nested_blocks"]
ORACLES["nested_known_keys"] = """select k as number, case when ok then 'Part' || (k % 1000) end as component,
    case when ok then y end::int as year, case when ok then k % 2 = 0 end as open, case when ok then 'p' || (k % 3) end as role
    from (select o_orderkey as k, year(o_orderdate) as y, o_orderkey % 7 > 1 as ok from orders)"""
# a detail page has 8 elements and perhaps a frame; a change in its body changes body and html
ORACLES["page_drift_degree"] = f"""with sizes as (
      select '{SITE}/movie/' || p_partkey as url, p_size as s, 8 + (p_partkey % 2 = 0)::bigint as n from part
    ), counted as (
      select url, case when s = 11 then 0 when s % 5 = 0 then n + 2 when s % 5 = 1 then n + 1 when s % 5 = 2 then 2 else n end as n_was,
        case when s = 7 then 0 else n end as n_is,
        case when s in (7, 11) then 0 when s % 5 in (0, 1) then n - 2 when s % 5 = 2 then 0 else n end as shared,
        case when s = 11 then 'new' when s = 7 then 'gone' when s % 5 < 3 then 'changed' else 'same' end as status from sizes
    )
    select url, status, n_was::bigint as n_was, n_is::bigint as n_is, (n_was - shared)::bigint as n_lost, (n_is - shared)::bigint as n_added,
      (n_was + n_is - 2 * shared) / (n_was + n_is)::double as degree, (n_was + n_is - 2 * shared) / (n_was + n_is)::double > 0.2 as significant
    from counted"""
ORACLES["main_texts"] = f"""select doc_id as page_id, greatest(words, 5)::bigint as points,
    case when words >= 10 then {strip('text')} end as main_text
    from (select doc_id, text, len(regexp_extract_all(text, '[^ \\t\\n\\x0B\\f\\r]+')) as words from documents)"""
ORACLES["title_ranking"] = f"""with {LINKED.split(", keyed as (")[0]}, titled as (
      select item_id, string_split(trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')), ' ') as words from both_sources where title is not null
    ), held as (select item_id, w, count(*)::bigint as tf, any_value(n)::bigint as n from (
        select item_id, unnest(words) as w, len(words) as n from titled) group by 1, 2),
    corpus as (select count(*)::bigint as docs, sum(len(words))::bigint as total from titled),
    weights as (select w, floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1)::double))::bigint as weight from held, corpus group by w),
    asked as (select item_id as query_id, w, tf as k from held where item_id < 1000000000 and item_id % 50 = 0),
    scores as (
      select query_id, h.item_id, sum(k * weight * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * docs) // total))))::bigint as score
      from asked join held h using (w) join weights using (w), corpus group by 1, 2),
    ranked as (select *, row_number() over (partition by query_id order by score desc, item_id) as rank from scores where score > 0)
    select query_id, rank::int as rank, item_id, score from ranked where rank <= 10"""
ORACLES["streamed_exactly_once"] = ORACLES["streamed_pages"]
