"""DuckDB statements that compute the registered queries independently of Spark."""

from __future__ import annotations

from checks import derived
from checks.queries import GRID_KS, GRID_SHARES, K, KEYWORD, KEYWORDS, MONTH_K, SHARE
from postlens.functions.stopwords import ENGLISH
from postlens.operators import topics
from postlens.plans.model_runs import METHODS

WORD = r"[\p{L}\p{N}_]"
NON_SPACE = r"[^\s\p{Z}\x0B\x1C-\x1F\x85]"


def quoted(values) -> str:
    return ", ".join("'" + v + "'" for v in values)


def strip(text: str) -> str:
    out = f"coalesce({text}, '')"
    for pattern in ("&amp;", f"http{NON_SPACE}+", rf"{NON_SPACE}+\.com{NON_SPACE}+", f"@{WORD}+", f"#{WORD}+"):
        out = f"regexp_replace({out}, '{pattern}', '', 'g')"
    return out


def words(text: str) -> str:
    out = f"regexp_replace(lower({strip(text)}), '[^A-Za-z]', ' ', 'g')"
    for head, tail in (("can", "not"), ("gim", "me"), ("gon", "na"), ("got", "ta"), ("lem", "me"), ("wan", "na")):
        out = rf"regexp_replace({out}, '\b{head}{tail}\b', '{head} {tail}', 'g')"
    return f"list_filter(string_split({out}, ' '), lambda w: w not in ('', {quoted(ENGLISH)}))"


def terms(text: str) -> str:
    return rf"regexp_extract_all(lower(coalesce({text}, '')), '{WORD}{{2,}}')"


def ngram_list(tokens: str, n: int) -> str:
    parts = " || ' ' || ".join(f"{tokens}[i + {j}]" for j in range(n))
    return f"list_transform(range(1, len({tokens}) - {n - 2}), lambda i: {parts})"


def unit(seed: str, key: str = "id") -> str:
    return f"((('0x' || substr(md5({seed} || ':' || {key}), 1, 8))::bigint + 1) / 4294967297::double)"


def half_even(x: str) -> str:
    return f"round_even(({x}) * 100::double, 0) / 100::double"


def bare(items: str) -> str:
    """A list as a string without list punctuation."""
    return f"array_to_string(list_transform({items}, lambda x: regexp_replace(x, '[,\\[\\]'']', '', 'g')), ' ')"


ARCHIVE = """archive as (
  select doc_id as id, date '2021-01-01' + cast((doc_id * 7) % 396 as int) as date,
    source as username, 'Name ' || source as display_name,
    case when doc_id % 25 = 3 then '' else text || ' &amp; @' || source || ' #Tag_' || lang
      || ' https://x.io/' || doc_id || ' foo.com/a bar.com' end as content,
    doc_id % 7 as reply_count, doc_id % 5 as retweet_count, doc_id % 11 as like_count, doc_id % 3 as quote_count,
    case when doc_id % 3 = 0 then null else '[User(username=''' || source || ''', id=' || doc_id
      || ', displayname=''Name ' || source || ''', description=None), User(username=''' || lang
      || '_desk'', id=1, displayname=''' || lang || ''', description=None)]' end as mentioned_users,
    case when doc_id % 4 = 0 then null else '[''' || upper(lang) || ''', ''' || source || ''''
      || case when doc_id % 5 = 1 then ', ''MeToo''' else '' end
      || case when doc_id % 10 = 1 then ', ''WhyIStayed''' else '' end || ']' end as hashtags,
    lang, 'https://x.io/' || doc_id as url
  from documents)"""

CAPTURED = f"""{ARCHIVE.replace('archive as (', 'plain_archive as (', 1)},
awkward as (
  select * exclude (lang, url, content, mentioned_users, hashtags), nullif(content, '') as content,
    case when id % 11 = 5 then '[User(username=''plain'', id=1, displayname=None, description=None), User(username=''' || lang
      || ''', id=2, displayname=''Last, First'', description=None), User(username=''q'', id=3, displayname="O''Hara", description=None)]'
      else mentioned_users end as mentioned_users,
    case when id % 13 = 4 then '[''ok'', ''a\\xa0b'', "it''s"]' else hashtags end as hashtags, 'a' as capture
  from plain_archive),
archive as materialized (
  select * from awkward
  union all by name select * replace ('b' as capture) from awkward where id % 10 = 0
  union all by name select * replace ('[''again'']' as hashtags, like_count + 100 as like_count) from awkward where id % 15 = 1)"""

_REST = f"""lexicon as (
  select word, ((('0x' || substr(md5(word), 1, 4))::int % 21) - 10) / 10 as polarity,
    (('0x' || substr(md5(word), 5, 4))::int % 11) / 10 as subjectivity
  from (select distinct unnest({words('text')}) as word from benchmark)),
cleaned as materialized (
  select capture, row_number() over () as r, id, cast(date as date) as date, cast(date_trunc('month', date) as date) as month, username, display_name,
    reply_count, retweet_count, like_count, quote_count, mentioned_users, hashtags as raw_hashtags,
    {words('content')} as words
  from archive),
scores as (
  select r, sum(round(polarity * 1e6)::bigint) / (1e6 * count(*)) as sentiment,
    sum(round(subjectivity * 1e6)::bigint) / (1e6 * count(*)) as subjectivity
  from (select r, unnest(words) as word from cleaned) join lexicon using (word) group by r),
base as materialized (
  select c.*, array_to_string(words, ' ') as content, coalesce(sentiment, 0) as sentiment,
    case when coalesce(sentiment, 0) >= 0 then 'Positive' else 'Negative' end as polarity,
    coalesce(subjectivity, 0) as subjectivity,
    list_transform(string_split(mentioned_users, 'username=''')[2:], lambda u: regexp_extract(u, '^(.*?)''', 1)) as users,
    list_transform(string_split(mentioned_users, 'username=''')[2:], lambda u:
      case when regexp_matches(u, 'displayname=''(.*?)'',') then regexp_extract(u, 'displayname=''(.*?)'',', 1)
        when regexp_matches(u, 'displayname="(.*?)",') then regexp_extract(u, 'displayname="(.*?)",', 1) end) as names,
    case when contains(raw_hashtags, 'xa0') then ['ok', 'a' || chr(160) || 'b', 'it''s']
      else regexp_extract_all(raw_hashtags, '''(.*?)''', 1) end as tags
  from cleaned c left join scores using (r)),
mentions as (
  select capture, id, date, month, sentiment, {bare('users')} as username, {bare('names')} as display_name
  from base where mentioned_users is not null),
mention_rows as (
  select capture, id, date, month, sentiment, unnest(users) as username, unnest(names) as display_name
  from base where mentioned_users is not null),
hashtags as (
  select capture, id, date, month, sentiment, lower({bare('tags')}) as hashtags
  from base where raw_hashtags is not null),
hashtag_rows as (
  select capture, id, date, month, sentiment, '#' || lower(unnest(tags)) as hashtags
  from base where raw_hashtags is not null),
posts as materialized (
  select capture, id, b.date, b.month, b.username, b.display_name, content, reply_count, retweet_count, like_count,
    quote_count, b.sentiment, polarity, subjectivity, m.username as mentioned_usernames,
    m.display_name as mentioned_display_names, h.hashtags
  from base b left join mentions m using (capture, id) left join hashtags h using (capture, id))"""
_ONE_CAPTURE = ARCHIVE.replace("    lang, ", "    lang, '' as capture, ", 1)
BASE = f"{_ONE_CAPTURE},\n{_REST}"
CAPTURED_BASE = f"{CAPTURED},\n{_REST}"

_FLAG_ROWS = ", ".join(f"('{phrase}', {', '.join(map(str, flags))})" for phrase, flags in derived.FLAGS.items())
_FLAG_NAMES = ", ".join(derived.FLAG_NAMES)
LABELLED = f"""{BASE},
flags(phrase, {_FLAG_NAMES}) as (values {_FLAG_ROWS}),
counted as (
  select phrase, count(*) as count from (select unnest({terms('hashtags')}) as phrase from posts where hashtags is not null)
  group by phrase having count(*) > 1),
class_table as (
  select 1 as "row", phrase, count, {', '.join(f'coalesce({n}, 0) as {n}' for n in derived.FLAG_NAMES)}
  from counted left join flags using (phrase)
  union all
  select 2, phrase, count // 2, {', '.join(f'coalesce({n}, 0)' for n in derived.FLAG_NAMES)}
  from counted left join flags using (phrase) where phrase = '{derived.REPEATED}'
  union all
  select 2, phrase, null, {', '.join(f'coalesce({n}, 0)' for n in derived.FLAG_NAMES)}
  from counted left join flags using (phrase) where phrase = '{derived.BLANKED}'),
lookup as (select * from class_table where survivor + domestic_violence + politics + health > 0),
weights as (
  select phrase, max(survivor) as survivor, arg_max_null(count * domestic_violence, "row") as domestic_violence,
    arg_max_null(count * politics, "row") as politics, arg_max_null(count * health, "row") as health
  from lookup group by phrase),
model_rows as (
  select id, username, month, content as contents, {half_even('sentiment')} as sentiment,
    {half_even('subjectivity')} as subjectivity, coalesce(mentioned_usernames, '') as mentions,
    coalesce(hashtags, '') as hashtags
  from posts where content <> ''),
train_rows as materialized (select * exclude (username, month) from model_rows where month <> date '2022-01-01'),
month_rows as materialized (select * exclude (month) from model_rows where month = date '2022-01-01'),
weighed as (
  select t.id, coalesce(sum(survivor), 0)::bigint as survivor,
    coalesce(sum(domestic_violence), 0)::bigint as domestic_violence,
    coalesce(sum(politics), 0)::bigint as politics, coalesce(sum(health), 0)::bigint as health
  from (select id, unnest(string_split(hashtags, ' ')) as phrase from train_rows) t left join weights using (phrase)
  group by t.id),
largest as (
  select *, case when domestic_violence >= politics and domestic_violence >= health then 'Domestic Violence'
    when politics >= health then 'Politics' else 'Health' end as top from weighed),
labelled as materialized (
  select t.*, case when survivor = 1 then 'Victim/Survivor' else top end as category
  from train_rows t join largest using (id) where domestic_violence + politics > 0)"""

PREDICTIONS = f"""{LABELLED},
predictions as (
  select id, category as actual, case when toxic = 1 then 'Victim/Survivor' when quality = 0 then 'Other'
    else category end as prediction
  from labelled left join labels on doc_id = id)"""

MONTHLY = f"""{BASE},
months as (select distinct month from posts where year(month) <> 2022),
fields as (
  select 'tweet' as category, month, {terms('content')} as t from posts where month in (from months)
  union all select 'hashtag', month, {terms('hashtags')} from hashtags where month in (from months)
  union all select 'mention', month, {terms('username')} from mentions where month in (from months)),
grams as (
  select category, month, 'unigram' as ngram_type, unnest({ngram_list('t', 1)}) as phrase from fields
  union all select category, month, 'bigram', unnest({ngram_list('t', 2)}) from fields
  union all select category, month, 'trigram', unnest({ngram_list('t', 3)}) from fields),
monthly as (
  select category, ngram_type, month, phrase, count(*) as count from grams group by all having count(*) > 1)"""


def draw(runs: list[tuple[int, int, float, str]]) -> str:
    """``drawn`` (run, id, category) out of ``labelled`` for (run, method, share, seed)."""
    merged = "case when category = 'Victim/Survivor' then category else 'Other' end"
    parts = []
    for run, method, share, seed in runs:
        drawn_as = merged if method == 4 else "category"
        final = merged if method in (2, 3, 4) else "category"
        weight = f"(count(*) over () - count(*) over (partition by {drawn_as}))" if method in (1, 3, 4) else "1"
        parts.append(
            f"""select {run} as run, id, category from (
  select id, {final} as category, row_number() over (order by ln({unit(f"'{seed}'")}) / w desc, id) as place
  from (select *, {weight} as w from labelled) where w > 0)
where place <= (select floor(count(*) * {share}) from labelled)"""
        )
    return "drawn as materialized (" + "\nunion all ".join(parts) + ")"


SPLIT = f"""parted as (
  select *, row_number() over (partition by run, category order by {unit("seed")}, id)
    <= round(0.2 * count(*) over (partition by run, category)) as is_test
  from (select *, '%s' as seed from rows_in)),
train as materialized (select * from parted where not is_test),
test as materialized (select * from parted where is_test)"""


def tfidf(source: str, name: str) -> str:
    """``<name>`` (run, id, block, token, weight) of ``source``, by the vocabulary ``idf``."""
    blocks = "\nunion all ".join(
        f"select run, id, '{b}' as block, unnest({terms(b)}) as token from {source}"
        for b in ("contents", "mentions", "hashtags")
    )
    return f"""{name}_tf as (select run, id, block, token, count(*) as tf from ({blocks}) group by all)""", f"""{name} as materialized (
  select run, id, block, token, tf * idf / sqrt(sum(tf * idf * tf * idf) over (partition by run, id, block)) as weight
  from {name}_tf join idf using (run, block, token))"""


def fit(source: str = "train") -> str:
    counts, weights = tfidf(source, "train_weights")
    return f"""{counts},
sizes as (select run, count(*) as n from {source} group by run),
idf as materialized (
  select run, block, token, count(*) as df, ln((1 + any_value(n)) / (1 + count(*))::double) + 1 as idf
  from train_weights_tf join sizes using (run) group by run, block, token),
{weights}"""


def search(k: int, query: str = "test") -> str:
    counts, weights = tfidf(query, "query_weights")
    return f"""{fit()},
{counts},
{weights},
filled as (
  select 'q' as side, run, id, count(distinct block) as blocks from query_weights group by run, id
  union all select 't', run, id, count(distinct block) from train_weights group by run, id),
dots as (
  select run, q.id, t.id as train_id, sum(q.weight * t.weight) as dot
  from query_weights q join train_weights t using (run, block, token) group by run, q.id, t.id),
pairs as (
  select q.run, q.id, t.id as train_id, t.category, round(coalesce(fq.blocks, 0) + coalesce(ft.blocks, 0)
    - 2 * coalesce(dot, 0) + (q.sentiment - t.sentiment) ** 2 + (q.subjectivity - t.subjectivity) ** 2, 9) as distance2
  from {query} q join train t on q.run = t.run
  left join filled fq on fq.side = 'q' and fq.run = q.run and fq.id = q.id
  left join filled ft on ft.side = 't' and ft.run = t.run and ft.id = t.id
  left join dots d on d.run = q.run and d.id = q.id and d.train_id = t.id),
nearest as materialized (
  select * from (select *, row_number() over (partition by run, id order by distance2, train_id) as rank from pairs)
  where rank <= {k})"""


def votes(ks) -> str:
    return f"""votes as materialized (
  select run, id, k, category as prediction from (
    select run, id, k, category, row_number() over (partition by run, id, k order by count(*) desc, category) as place
    from nearest, unnest([{', '.join(map(str, ks))}]) as ks(k) where rank <= k group by run, id, k, category)
  where place = 1)"""


ONE_RUN = "rows_in as materialized (select 0 as run, * from labelled)"


def six(column: str) -> str:
    return f"round({column}, 6) as {column}"


def stacked(blank: bool) -> str:
    def text(column):
        return f"coalesce({column}, '')" if blank else column

    nothing = "null"
    return f"""
select 'posts' as family, id, month, {text('content')} as content, {six('sentiment')}, username, display_name,
  {text('mentioned_usernames')} as mentioned_usernames, {text('mentioned_display_names')} as mentioned_display_names,
  {text('hashtags')} as hashtags from posts
union all select 'mentions', id, month, {nothing}, round(sentiment, 6), {text('username')}, {text('display_name')}, {nothing}, {nothing}, {nothing} from mentions
union all select 'mention_lists', id, month, {nothing}, round(sentiment, 6), {text('username')}, {text('display_name')}, {nothing}, {nothing}, {nothing} from mention_rows
union all select 'hashtags', id, month, {nothing}, round(sentiment, 6), {nothing}, {nothing}, {nothing}, {nothing}, {text('hashtags')} from hashtags
union all select 'hashtag_lists', id, month, {nothing}, round(sentiment, 6), {nothing}, {nothing}, {nothing}, {nothing}, {text('hashtags')} from hashtag_rows"""


def _topic_posts() -> str:
    columns = "content, sentiment, username, display_name, mentioned_usernames, mentioned_display_names, hashtags"
    return f"""select * from ({stacked(True)})
union all select 'post_topics', id, month, {columns} from ({stacked(True)}) where family = 'posts'"""


def _psi(x: str) -> str:
    """The derivative of log gamma by the steps and the series of ``topics.digamma``."""
    z = f"(1.0::double / (({x} + 10) * ({x} + 10)))"
    below = " + ".join(f"1.0::double / ({x} + {i})" for i in range(10))
    series = f"{z} * (1.0::double / 12 - {z} * (1.0::double / 120 - {z} * (1.0::double / 252 - {z} * (1.0::double / 240 - {z} / 132))))"
    return f"(ln({x} + 10) - 0.5::double / ({x} + 10) - {series} - ({below}))"


def _topics() -> str:
    """The passes of the topic model, one after the other: ``weights_<n>`` and ``posts_<n>``; ``posts`` hold lists over their words."""
    k, last, prior = topics.TOPICS, topics.PASSES, f"(1.0::double / {topics.TOPICS})"
    draws = ", ".join(f"-ln(1.0::double - {unit(f"'topics-{i}'", 'word')})" for i in range(k))
    steps = [
        f"""{BASE},
topic_counts as materialized (
  select id, word, count(*) as n from (select id, unnest(words) as word from base) group by id, word),
weights_0 as materialized (
  select word, list_transform(draws, lambda d: floor(n * (d / list_sum(draws)) * 1e6::double + 0.5::double)::bigint) as s
  from (select word, sum(n)::bigint as n, [{draws}] as draws from topic_counts group by word))"""
    ]
    theta = f"list_transform(g, lambda x: exp({_psi('x')} - psi_all))"
    inner = f"""list_transform([list_transform({{g}}, lambda x: exp({_psi('x')} - {_psi('list_sum({g})')}))], lambda t: {{body}})[1]"""
    # one turn: the shares t, the ratios of the words, the new parameters, and how far they moved
    turn = inner.replace("{g}", "g").replace(
        "{body}",
        f"""list_transform([list_transform(range(1, len(ns) + 1), lambda i: ns[i] / list_inner_product(bw[i], t))], lambda q:
        list_transform(range(1, {k} + 1), lambda j: {prior} + t[j] * list_inner_product(q, bt[j])))[1]""",
    )
    settled = f"""list_reduce(list_transform(range({topics.TURNS}), lambda i: []::double[]), lambda acc, step:
      case when acc[{k + 1}] < {topics.TOLERANCE}::double then acc else
      list_transform([acc[1 : {k}]], lambda g: list_transform([{turn}], lambda new:
        list_append(new, list_sum(list_transform(range(1, {k} + 1), lambda j: abs(new[j] - g[j]))) / {k}))[1])[1] end,
      list_append(list_transform(range({k}), lambda i: {prior} + list_sum(ns) / {k}), 1e9::double))"""
    for step in range(last + 1):
        steps.append(
            f"""expected_{step} as materialized (
  select word, list_transform(range(1, {k} + 1), lambda j: exp({_psi('(s[j] / 1e6::double + ' + prior + ')')} - base[j])) as b
  from weights_{step}, (select list_transform(z, lambda x: {_psi('x')}) as base from (select [{", ".join(f"sum(s[{j + 1}]) / 1e6::double + {prior} * count(*)" for j in range(k))}] as z from weights_{step}))),
posts_{step} as materialized (
  select id, words, ns, bw, {settled}[1 : {k}] as g from (
    select *, list_transform(range(1, {k} + 1), lambda j: list_transform(bw, lambda b: b[j])) as bt from (
      select id, list(word order by word) as words, list(n::double order by word) as ns, list(b order by word) as bw
      from topic_counts join expected_{step} using (word) group by id)))"""
        )
        if step < last:
            sums = ", ".join(f"sum(floor(t[{j + 1}] * b[{j + 1}] * (n / evidence) * 1e6::double + 0.5::double)::bigint)::bigint" for j in range(k))
            steps.append(
                f"""weights_{step + 1} as materialized (
  select word, [{sums}] as s from (
    select word, n, b, t, list_inner_product(b, t) as evidence from (
      select unnest(words) as word, unnest(ns) as n, unnest(bw) as b, {theta} as t
      from (select *, {_psi('list_sum(g)')} as psi_all from posts_{step}))) group by word)"""
            )
    by_topic = " union all ".join(f"select {j} as topic, word, s[{j + 1}] as weight from weights_{last}" for j in range(k))
    steps.append(
        f"""placed as (select id, list_position(g, list_max(g)) - 1 as topic from posts_{last}),
topic_words as (
  select topic, string_agg(word, ' ' order by weight desc, word) as described
  from (select *, row_number() over (partition by topic order by weight desc, word) as place from ({by_topic}))
  where place <= {topics.LABEL_WORDS} group by topic),
topic_names as (select topic, array_to_string({words('described')}, ' ') as topic_label from topic_words)"""
    )
    return ",\n".join(steps)


POSTS_OUT = f"""with {CAPTURED_BASE} select id, date, month, username, display_name, content, reply_count, retweet_count,
  like_count, quote_count, {six('sentiment')}, polarity, {six('subjectivity')}, mentioned_usernames,
  mentioned_display_names, hashtags from posts"""


def _both(expression) -> str:
    return f"""with {ARCHIVE} select 'post' as kind, id, {expression('content')} as text from archive
union all select 'page', page_id, {expression('html')} from pages"""


def _outcome(target: str) -> str:
    return (
        "case when actual = prediction then 'True' else 'False' end || '-' || "
        f"case when prediction = '{target}' then 'Positive' else 'Negative' end"
    )


def _method(number: int) -> str:
    return f"with {LABELLED}, {draw([(0, number, SHARE, 'method')])} select id, category from drawn"


_SAMPLES = "rows_in as materialized (select d.run, l.* exclude (category), d.category from drawn d join labelled l using (id))"


def _method_testing() -> str:
    runs = [(m, m, SHARE, f"test-{m}") for m in range(5)]
    return f"""with {LABELLED}, {draw(runs)}, {_SAMPLES}, {SPLIT % 'split_seed'},
{search(K)}, {votes([K])},
results as (select v.run, v.prediction, t.category as actual from votes v join test t using (run, id)),
general as (
  select run, {half_even("avg(case when actual = prediction then 1.0::double else 0 end)")} as general_accuracy
  from results group by run),
drawn_sizes as (select run, count(*) as samples from drawn group by run),
checked as (
  select run, actual, 'survivor' as "check", {_outcome('Victim/Survivor')} as outcome from results
  union all select run, actual, 'other', {_outcome('Other')} from results)
select actual as category, outcome as accuracy, count(*) as count, run as method, any_value(general_accuracy) as general_accuracy,
  any_value(samples) as samples, {K} as neighbour, "check"
from checked join general using (run) join drawn_sizes using (run) group by actual, outcome, run, "check\"""".replace(
        "split_seed", "test"
    )


def _grid() -> str:
    cells = [(s, m) for s in range(len(GRID_SHARES)) for m in range(5)]
    runs = [(i, m, GRID_SHARES[s], f"grid-{s}-{m}") for i, (s, m) in enumerate(cells)]
    settings, key = [], 0
    for s in range(len(GRID_SHARES)):
        for k in GRID_KS:
            for m in range(5):
                settings.append(f"({key}, {cells.index((s, m))}, {k}, '{METHODS[m]}')")
                key += 1
    return f"""with {LABELLED}, {draw(runs)}, {_SAMPLES}, {SPLIT % 'grid'},
{search(max(GRID_KS))}, {votes(GRID_KS)},
settings(key, run, k, method) as (values {', '.join(settings)}),
drawn_sizes as (select run, count(*) as samples from drawn group by run),
results as (
  select s.key, v.prediction, t.category as actual from votes v join test t using (run, id)
  join settings s on s.run = v.run and s.k = v.k),
general as (
  select key, {half_even("avg(case when actual = prediction then 1.0::double else 0 end)")} as accuracy
  from results group by key),
classes as (
  select key, actual as category, count(*) filter (where actual = prediction) as correct,
    count(*) filter (where actual <> prediction) as incorrect from results group by key, actual),
shares as (
  select key, category, n / sum(n) over (partition by key) as distribution
  from (select key, category, count(*) as n from drawn join settings using (run) group by key, category))
select key, samples, k as neighbours, method, round(accuracy, 6) as accuracy, category,
  round(distribution, 6) as distribution, coalesce(correct, 0) as correct, coalesce(incorrect, 0) as incorrect,
  round(coalesce(correct / (correct + incorrect), 0), 6) as class_accuracy
from shares join settings using (key) join drawn_sizes using (run) join general using (key)
left join classes using (key, category)"""


def statements() -> dict[str, str]:
    sql = {
        "capture_monthly": f"""with {ARCHIVE} select id, date::date as date, username, content,
  date_trunc('month', date)::date as window_start, (date_trunc('month', date) + interval 1 month)::date as window_end
  from archive where date >= date '2021-03-01' and date < date '2021-07-01' and lang = 'en'
    and contains(lower(content), '{KEYWORD}')""",
        "capture_keywords": f"""with {ARCHIVE} select keyword, id, date::date as date,
  keyword || '/en/' || date_trunc('month', date)::date as capture,
  date_trunc('month', date)::date as window_start, (date_trunc('month', date) + interval 1 month)::date as window_end
  from archive, (select unnest([{", ".join(f"'{k}'" for k in KEYWORDS)}]) as keyword)
  where date >= date '2021-03-01' and date < date '2021-07-01' and lang = 'en' and contains(lower(content), lower(keyword))""",
        "capture_window": f"""with {ARCHIVE} select id, date::date as date, username, content, url
  from archive where date >= date '2022-01-01' and date < date '2022-01-31' and lang = 'en'
    and contains(lower(content), '{KEYWORD}')""",
        "read_raw": f"with {ARCHIVE} select * exclude (lang, url, date), date::date as date from archive",
        "union_files": f"with {CAPTURED_BASE} {stacked(False)}",
        "load_text_tables": f"with {CAPTURED_BASE} {_topic_posts()}",
        "class_lookup": f'with {LABELLED} select "row", phrase, count, {_FLAG_NAMES} from lookup',
        "bi_export": f"""with {CAPTURED_BASE}
select 'posts' as report, id, date::varchar as date, username, display_name, content, like_count::varchar as like_count,
  polarity, (id % 10)::varchar as topic, case when id % 10 < 9 then 'topic ' || (id % 10) end as topic_label, null as hashtags from posts
union all select 'hashtags', id, null, null, null, null, null, null, null, null, hashtags from hashtag_rows
union all select 'mentions', id, null, username, display_name, null, null, null, null, null, null from mention_rows""",
        "clean_remove": _both(strip),
        "clean_text": _both(lambda c: f"array_to_string({words(c)}, ' ')"),
        "date_parts": "select event_id, ts::date as date, date_trunc('month', ts)::date as month from events",
        "polarity_label": f"with {BASE} select id, polarity from base",
        "round_scores": f"""with {BASE} select id, {half_even('sentiment')} as sentiment,
  {half_even('subjectivity')} as subjectivity from base""",
        "train_validation_filter": f"""with {LABELLED} select *, null as username, 'train' as part from train_rows
union all by name select *, 'validation' as part from month_rows""",
        "month_exclusion": f"with {BASE} select id, month from base where year(month) <> 2022",
        "prediction_check": f"""with {PREDICTIONS} select *,
  case when actual = prediction then 'Correct' else 'Incorrect' end as "check" from predictions""",
        "tfpn_check": f"""with {PREDICTIONS} select *, {_outcome('Victim/Survivor')} as survivor_check,
  {_outcome('Other')} as other_check from predictions""",
        "mention_parse": f"""with {CAPTURED_BASE} select id, capture, array_to_string(users, '|') as usernames,
  array_to_string(list_transform(names, lambda n: coalesce(n, '?')), '|') as display_names
  from base where mentioned_users is not null""",
        "mention_lists": f"with {CAPTURED_BASE} select * exclude (sentiment) from mention_rows",
        "mention_strings": f"with {CAPTURED_BASE} select * exclude (sentiment) from mentions",
        "hashtag_parse": f"""with {CAPTURED_BASE} select capture, id, array_to_string(tags, '|') as tags
  from base where raw_hashtags is not null""",
        "hashtag_lists": f"with {CAPTURED_BASE} select * exclude (sentiment) from hashtag_rows",
        "hashtag_strings": f"with {CAPTURED_BASE} select * exclude (sentiment) from hashtags",
        "post_enrich": POSTS_OUT,
        "join_mentions": f"""with {CAPTURED_BASE} select capture, id, b.month, b.like_count, m.username as mentioned_usernames,
  m.display_name as mentioned_display_names from base b left join mentions m using (capture, id)""",
        "join_hashtags": f"""with {CAPTURED_BASE} select capture, id, b.month, b.like_count, h.hashtags
  from base b left join hashtags h using (capture, id)""",
        "join_topic_label": f"""with {ARCHIVE} select id, username, (id % 10)::int as topic,
  case when id % 10 < 9 then 'topic ' || (id % 10) end as topic_label from archive""",
        "join_validation_raw": f"""with {LABELLED} select m.id, m.mentions, m.hashtags, a.display_name, a.content, a.url
  from month_rows m join archive a using (id)""",
        "hashtag_weight_lookup": f"""with {LABELLED} select id, hashtags, survivor, domestic_violence, politics, health
  from weighed join train_rows using (id)""",
        "month_semi": f"""with {BASE} select id, month, hashtags from hashtag_rows
  where month in (select month from posts where year(month) <> 2022)""",
        "ngram_counts": "with t as (select " + terms("text") + " as t from documents)\n" + "\nunion all ".join(
            f"select phrase, count(*) as count, {n} as n from (select unnest({ngram_list('t', n)}) as phrase from t) group by phrase having count(*) > 1"
            for n in (1, 2, 3)
        ),
        "monthly_ngrams": f"with {MONTHLY} select * from monthly",
        "monthly_ngrams_by_levels": f"with {MONTHLY} select * from monthly",
        "collated_ngrams": f"""with {MONTHLY} select phrase, count, month, upper(category[1]) || category[2:] as category,
  upper(ngram_type[1]) || ngram_type[2:] || 's' as ngram_type from monthly""",
        "distinct_months": f"with {ARCHIVE} select distinct date_trunc('month', date)::date as month from archive",
        "class_counts": f"with {LABELLED} select id, category, count(*) over (partition by category) as class_count from labelled",
        "class_distribution": f"""with {LABELLED} select category,
  round(count(*) / (select count(*) from labelled), 6) as distribution from labelled group by category""",
        "confusion_pivot": f"""with {PREDICTIONS} select actual as category, count(*) filter (where actual = prediction) as correct,
  count(*) filter (where actual <> prediction) as incorrect,
  round(avg(case when actual = prediction then 1.0::double else 0 end), 6) as accuracy from predictions group by actual""",
        "overall_accuracy": f"""with {PREDICTIONS} select
  {half_even("avg(case when actual = prediction then 1.0::double else 0 end)")} as accuracy from predictions""",
        "tfpn_summary": f"""with {PREDICTIONS} select actual as category, {_outcome('Victim/Survivor')} as accuracy,
  count(*) as count from predictions group by all""",
        "sentiment_mean": f"with {BASE} select id, {six('sentiment')}, {six('subjectivity')} from base",
        "sentiment_modified": f"""with {BASE},
strong as (
  select word, round(polarity * 1e6) as p, round(subjectivity * 1e6) as s,
    case ('0x' || substr(md5(word), 9, 4))::int % 10 when 0 then 1300000 when 1 then 500000 else 1000000 end as i, 1 as known
  from lexicon
  union all select word, 0, 0, 1000000, 0 from unnest([{quoted(derived.NEGATIONS)}]) as n(word)
  where word not in (select word from lexicon)),
placed as (select id, unnest(words) as word, generate_subscripts(words, 1) as at from cleaned),
hits as (select *, word in ({quoted(derived.NEGATIONS)}) as negation, known = 1 and i <> 1000000 as modifier
  from placed join strong using (word)),
near as (
  select h.*, a.i as pi, coalesce(a.modifier, false) as modified,
    coalesce(a.modifier and b.negation, false) as inverted,
    coalesce(a.negation, false) or coalesce(a.modifier and b.negation, false) as negated,
    h.modifier and coalesce(n.known = 1, false) as absorbed
  from hits h left join hits a on a.id = h.id and a.at = h.at - 1
  left join hits b on b.id = h.id and b.at = h.at - 2
  left join hits n on n.id = h.id and n.at = h.at + 1),
scaled as (
  select *, case when inverted then 1 / (pi / 1e6) when modified then pi / 1e6 else 1e0 end as f
  from near where known = 1 and not absorbed),
clamped as (
  select id, negated, greatest(least(round_even(p * f, 0), 1e6), -1e6) as p, greatest(least(round_even(s * f, 0), 1e6), -1e6) as s
  from scaled),
means as (
  select id, sum(case when negated then round_even(p * -0.5::double, 0) else p end) / (1e6 * count(*)) as sentiment,
    sum(s) / (1e6 * count(*)) as subjectivity from clamped group by id)
select c.id, round(coalesce(m.sentiment, 0), 6) as sentiment,
  case when coalesce(m.sentiment, 0) >= 0 then 'Positive' else 'Negative' end as polarity,
  round(coalesce(m.subjectivity, 0), 6) as subjectivity
from cleaned c left join means m using (id)""",
        "top_words": f"""with {BASE} select phrase, count(*) as count
  from (select unnest({ngram_list('t', 2)}) as phrase from (select {terms('content')} as t from base))
  where phrase not in ({quoted(derived.EXCLUSIONS)}) and contains(phrase, 'en')
  group by phrase order by count desc, phrase limit 20""",
        "top_words_by_summaries": f"""with {BASE} select phrase, count(*) as count
  from (select unnest({ngram_list('t', 2)}) as phrase from (select {terms('content')} as t from base))
  where phrase not in ({quoted(derived.EXCLUSIONS)}) and contains(phrase, 'en')
  group by phrase order by count desc, phrase limit 20""",
        "top_words_monthly": f"""with {BASE} select month, phrase, count(*) as count,
  row_number() over (partition by month order by count(*) desc, phrase) as rank
  from (select month, unnest({terms('content')}) as phrase from base) group by month, phrase qualify rank <= 20""",
        "sort_counts": f"""with {BASE} select phrase, count(*) as count from (select unnest({terms('content')}) as phrase from base)
  group by phrase having count(*) > 1 order by count desc, phrase""",
        "dominant_topic": "select vec_id, list_position(embedding, list_max(embedding)) - 1 as topic from embeddings",
        "largest_category": f"with {LABELLED} select id, top as category from largest",
        "sample_uniform": f"with {LABELLED}, {draw([(0, 0, SHARE, 'uniform')])} select id, category from drawn",
        "sample_weighted": f"with {LABELLED}, {draw([(0, 1, SHARE, 'weighted')])} select id, category from drawn",
        "stratified_split": f"with {LABELLED}, {ONE_RUN}, {SPLIT % 'split'} select id, category, is_test::int as is_test from parted",
        "knn_topk": f"""with {LABELLED}, {ONE_RUN}, {SPLIT % 'split'}, {search(K)}
select id, rank, train_id, category, {six('distance2')} from nearest""",
        "lexicon_sentiment": f"with {BASE} select id, {six('sentiment')}, polarity, {six('subjectivity')} from base",
        "label_posts": f"with {LABELLED} select * from labelled",
        "tfidf_fit": f"""with {LABELLED}, train as (select 0 as run, * from train_rows), {fit()}
select block, token, df, {six('idf')} from idf""",
        "tfidf_by_months": f"""with {LABELLED}, train as (select 0 as run, * from train_rows), {fit()}
select block, token, df, {six('idf')} from idf""",
        "tfidf_transform": f"""with {LABELLED}, train as (select 0 as run, * from train_rows),
test as (select 0 as run, * from month_rows), {fit()}, {', '.join(tfidf('test', 'query_weights'))}
select id, block, token, {six('weight')} from query_weights""",
        "assemble_features": f"""with {LABELLED}, train as (select 0 as run, * from train_rows), {fit()}
select id, block, token, {six('weight')} from train_weights
union all select id, 'sentiment', '', round(sentiment, 6) from train_rows
union all select id, 'subjectivity', '', round(subjectivity, 6) from train_rows""",
        "knn_classify": f"""with {LABELLED}, train as (select 0 as run, * from labelled),
test as (select 0 as run, * from month_rows), {search(K)}, {votes([K])} select id, prediction from votes""",
        "knn_holdout": f"""with {LABELLED}, {ONE_RUN}, {SPLIT % 'split'}, {search(K)}, {votes([K])}
select id, prediction, category as actual from votes join test using (id)""",
        "knn_grid": _grid(),
        "method_testing": _method_testing(),
        "knn_score_month": f"""with {LABELLED}, {draw([(0, 0, SHARE, 'month')])},
train as ({_SAMPLES.split('as materialized (')[1][:-1]}), test as (select 0 as run, * from month_rows),
{search(MONTH_K)}, {votes([MONTH_K])}
select t.id, t.username, a.display_name, a.content, t.sentiment, t.subjectivity, t.mentions, t.hashtags, v.prediction, a.url
from votes v join test t using (id) join archive a using (id)""",
        "ingest_inbox": POSTS_OUT,
        "stream_months": "select date_trunc('month', ts)::date as month, event_type, count(*) as n from events group by all",
        "topic_model": f"""with {_topics()} select b.id, coalesce(placed.topic, 0)::int as topic, topic_label
  from base b left join placed using (id) left join topic_names t on t.topic = coalesce(placed.topic, 0)""",
        "topic_labels": f"with {_topics()} select topic::int as topic, topic_label from topic_names",
    }
    for number in range(5):
        sql[f"apply_method_{number}"] = _method(number)
    return sql
