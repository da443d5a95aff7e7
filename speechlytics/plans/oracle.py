"""The queries in DuckDB's SQL, by other means than the engine's: edit distance as a dynamic programme over lists,
alignment by a recursive walk, digits straight from the numbers that were spelled."""

from __future__ import annotations

from ..functions import lexicon
from ..operators import sampling, spelling, taxonomy
from . import inputs
from .queries import BACKUP, FIX_DETAILS

_PAIRS = r"""
base AS (SELECT item_id AS id, list_filter(string_split_regex(coalesce(text, ''), '\s+'), lambda w: w <> '') AS ref FROM benchmark),
pairs AS (
    SELECT id, k::INT AS k, ref, list_transform(
        list_filter(list_transform(ref, lambda w, i: {'w': w, 'i': i - 1}), lambda x: k = 5 OR (x.i * 31 + id + 7 * k) % 11 <> 0),
        lambda x: CASE WHEN k < 4 AND (x.i * 17 + id) % 7 = 0 THEN x.w || 'q' WHEN k = 4 AND (x.i * 13 + id) % 19 = 0 THEN x.w || 'z'
                       WHEN k = 5 AND (x.i * 5 + id) % 23 = 0 THEN x.w || 'v' ELSE x.w END) AS hyp
    FROM base, (SELECT unnest(range(0, 6)) AS k)),
costs AS (SELECT *, list_transform(ref, lambda r: [list_transform(hyp, lambda h: (h <> r)::INT)]) AS cost FROM pairs),
matrix AS (
    SELECT *, list_reduce(cost, lambda acc, x: list_append(acc,
        list_reduce(list_transform(range(1, len(hyp) + 1), lambda j: [j::INT]),
            lambda cur, jj: list_append(cur, least(cur[jj[1]] + 1, acc[-1][jj[1] + 1] + 1, acc[-1][jj[1]] + x[1][jj[1]])), [acc[-1][1] + 1])
        ), [list_transform(range(0, len(hyp) + 1), lambda j: j::INT)]) AS d FROM costs),
errors AS (SELECT id, k, len(ref)::INT AS words, d[-1][-1]::INT AS errors, CASE WHEN len(ref) = 0 THEN 100.0 ELSE d[-1][-1] * 100.0::DOUBLE / len(ref) END AS wer_percent FROM matrix)"""

_ALIGNED = (
    _PAIRS
    + """,
walk AS (
    SELECT id, k, ref, hyp, d, len(ref)::INT AS i, len(hyp)::INT AS j, NULL::INT AS pos, NULL::VARCHAR AS word FROM matrix
    UNION ALL
    SELECT id, k, ref, hyp, d,
        (CASE WHEN diagonal OR deletion THEN i - 1 ELSE i END)::INT, (CASE WHEN diagonal OR NOT deletion THEN j - 1 ELSE j END)::INT,
        (CASE WHEN diagonal OR deletion THEN i - 1 END)::INT, CASE WHEN diagonal THEN hyp[j] WHEN deletion THEN '' END
    FROM (SELECT *, j > 0 AND d[i + 1][j + 1] = d[i][j] + (ref[i] <> hyp[j])::INT AS diagonal, d[i + 1][j + 1] = d[i][j + 1] + 1 AS deletion
          FROM (SELECT id, k, ref, hyp, d, i, j FROM walk WHERE i > 0))),
aligned AS (SELECT id, k, ref, pos, word FROM walk WHERE pos IS NOT NULL),
votes AS (SELECT id, pos, word, min(k) AS first_model, ref[pos + 1] AS own, count(*) AS n FROM aligned WHERE word <> '' GROUP BY ALL),
agreed AS (SELECT * FROM votes WHERE n >= 3 AND word <> own)"""
)

_PREDICTIONS = _PAIRS + ", predictions AS (SELECT id * 6 + k AS id, errors * (id % 5 + 1) * 100.0::DOUBLE / words AS wer_percent FROM errors)"
_LOW, _MEDIUM, _HIGH = sampling.QUOTAS
_SEVERITY = f"CASE WHEN wer_percent > -0.1 AND wer_percent <= 30 THEN '{_LOW}' WHEN wer_percent > 30 AND wer_percent <= 60 THEN '{_MEDIUM}' WHEN wer_percent > 60 THEN '{_HIGH}' END"
_SAMPLED = (
    _PREDICTIONS
    + f""",
placed AS (SELECT *, {_SEVERITY} AS severity FROM predictions),
ranked AS (SELECT *, row_number() OVER (PARTITION BY severity ORDER BY wer_percent, id) - 1 AS rank, count(*) OVER (PARTITION BY severity) AS size,
    CASE severity WHEN '{_LOW}' THEN {sampling.QUOTAS[_LOW]} WHEN '{_MEDIUM}' THEN {sampling.QUOTAS[_MEDIUM]} ELSE {sampling.QUOTAS[_HIGH]} END AS quota,
    CASE severity WHEN '{_LOW}' THEN 0 WHEN '{_MEDIUM}' THEN 1 ELSE 2 END AS place FROM placed WHERE severity IS NOT NULL),
stepped AS (SELECT *, greatest(1, size // least(quota, size)) AS step FROM ranked),
sampled AS (SELECT * FROM stepped WHERE rank % step = 0 AND rank // step < least(quota, size))"""
)

_SYLLABLE = lambda n: f"split_part('{inputs.SYLLABLES}', '|', ({n} % 12 + 1)::INT)"
_WORDS = f"""
plain AS (SELECT p_partkey AS k, {_SYLLABLE('p_partkey')} || {_SYLLABLE('(p_partkey // 12)')} || CASE WHEN p_partkey % 3 = 0 THEN {_SYLLABLE('(p_partkey // 5)')} ELSE '' END AS w FROM part),
words AS (SELECT k AS id, CASE WHEN k % 29 = 0 THEN w || 'ाी' WHEN k % 31 = 0 THEN w || '्' WHEN k % 37 = 0 THEN 'ि' || w WHEN k % 41 = 0 THEN w || 'a'
    WHEN k % 43 = 0 THEN w || 'ककक' WHEN k % 47 = 0 THEN w || '_' || w WHEN k % 53 = 0 THEN 'word' WHEN k % 59 = 0 THEN 'अा' || w WHEN k % 61 = 0 THEN repeat(w, 6) ELSE w END AS word FROM plain)"""
_HINDI = (
    _WORDS
    + """,
refs AS (SELECT id, 'यह ' || word || ' बात ' || word || 'ना' AS ref FROM words),
hindi AS (SELECT id, ref, CASE id % 8 WHEN 0 THEN replace(ref, 'ना', 'नी') WHEN 1 THEN ref || ' है' WHEN 2 THEN replace(ref, 'बात', 'बात्म') WHEN 3 THEN 'तीन ' || ref
    WHEN 4 THEN ref || ' Mobile फोन' WHEN 5 THEN ref || ' रामपुर रामपुर' WHEN 6 THEN replace(ref, 'बात', 'सड़कें') ELSE ref END AS hyp FROM refs)"""
)
_SETS = lambda a, b: f"list_sort(list_distinct({a})) <> list_sort(list_distinct({b}))"
_ALL = lambda t, p: f"regexp_extract_all({t}, '{p}')"
_NUMBERS = "string_split('" + taxonomy.NUMBER_WORDS + "', ' ')"
_TAXONOMY = (
    _HINDI
    + f""",
tokens AS (SELECT *, string_split(ref, ' ') AS rw, string_split(hyp, ' ') AS hw FROM hindi),
diffs AS (SELECT *, list_filter(list_concat(list_filter(rw, lambda w: NOT list_contains(hw, w)), list_filter(hw, lambda w: NOT list_contains(rw, w))), lambda w: length(w) > 3) AS changed,
    list_filter(range(1, len(hw)), lambda i: hw[i] = hw[i + 1] AND NOT contains(ref, hw[i])) AS repeats FROM tokens),
firsts AS (SELECT *, list_filter([
    CASE WHEN {_ALL('ref', taxonomy.MATRAS)} <> {_ALL('hyp', taxonomy.MATRAS)} AND (regexp_replace(ref, '{taxonomy.MATRAS}', '', 'g') = regexp_replace(hyp, '{taxonomy.MATRAS}', '', 'g')
        OR abs(len({_ALL('ref', taxonomy.MATRAS)}) - len({_ALL('hyp', taxonomy.MATRAS)})) > 2) THEN 'Matra/Vowel Marker Error' END,
    CASE WHEN length(ref) - length(replace(ref, '्', '')) <> length(hyp) - length(replace(hyp, '्', '')) THEN 'Conjunct Consonant Error' END,
    CASE WHEN regexp_matches(ref, '[0-9०-९]') <> regexp_matches(hyp, '[0-9०-९]') OR list_has_any(rw, {_NUMBERS}) <> list_has_any(hw, {_NUMBERS}) THEN 'Number/Digit Handling' END,
    CASE WHEN {_SETS(_ALL('ref', taxonomy.MARKERS), _ALL('hyp', taxonomy.MARKERS))} OR {_SETS(_ALL('ref', '[a-zA-Z]+'), _ALL('hyp', '[a-zA-Z]+'))} THEN 'English Loanword Error' END,
    CASE WHEN {_SETS('list_filter(rw, lambda w: length(w) <= 2)', 'list_filter(hw, lambda w: length(w) <= 2)')} THEN 'Short Word Insertion/Deletion' END], lambda x: x IS NOT NULL) AS f FROM diffs),
more AS (SELECT id, list_concat(f, list_filter([CASE WHEN len(f) = 0 AND len(changed) > 0 THEN 'Word Substitution' END, CASE WHEN len(repeats) > 0 THEN 'Repetition/Hallucination' END,
    CASE WHEN len(list_filter(changed, lambda w: regexp_matches(w, '^\\p{{Lu}}'))) > 0 THEN 'Proper Noun Confusion' END], lambda x: x IS NOT NULL)) AS l FROM firsts),
labelled AS (SELECT id, CASE WHEN len(l) = 0 THEN ['Other/Phonetic Similarity'] ELSE l END AS labels FROM more),
each AS (SELECT id, unnest(labels) AS category, unnest(range(0, len(labels))) AS place FROM labelled)"""
)
_DICTIONARY = _WORDS + f", known AS (SELECT unnest(string_split('{' '.join(lexicon.dictionary())}', ' ')) AS word UNION SELECT word FROM words WHERE id % 7 = 0 AND id % 29 <> 0)"
_PLAIN = lambda w: f"replace(replace(replace(replace({w}, '़', ''), 'ँ', 'ं'), 'ॉ', 'ो'), 'ॅ', 'े')"
_PURE = r"regexp_matches(word, '^[\x{0900}-\x{097F}\x{200C}\x{200D}]+$')"
_MOSTLY = r"len(regexp_extract_all(word, '[\x{0900}-\x{097F}]')) * 2 > length(word)"
_VERDICTS = (
    _DICTIONARY
    + rf""",
asked AS (SELECT word FROM words UNION SELECT word || 'वाला' FROM words UNION SELECT word || '़' FROM words WHERE id % 7 = 0),
suffixes AS (SELECT unnest(l) AS s, unnest(range(0, len(l))) AS n FROM (SELECT string_split('{' '.join(lexicon.SUFFIXES.split())}', ' ') AS l)),
cut AS (SELECT word, s, n, substr(word, 1, length(word) - length(s)) AS root FROM asked, suffixes WHERE ends_with(word, s) AND length(word) > length(s)),
tried AS (SELECT word, s, 2 * n AS o, root AS t, 'Root ''' AS how FROM cut UNION ALL SELECT word, s, 2 * n + 1, replace(replace(root, '़', ''), 'ँ', 'ं'), 'Root variant ''' FROM cut),
roots AS (SELECT t.word, min_by(how || t || ''' + suffix ''' || s || '''', o) AS reason FROM tried t JOIN known k ON t.t = k.word GROUP BY t.word),
faults AS (SELECT word, {_MOSTLY} AS mostly, {_PURE} AS pure, CASE
    WHEN regexp_matches(word, '[\x{{0900}}-\x{{097F}}].*[a-zA-Z]|[a-zA-Z].*[\x{{0900}}-\x{{097F}}]') THEN 'Invalid: mixed Roman + Devanagari script'
    WHEN regexp_matches(word, '[ािीुूृेैोौ]{{2,}}') THEN 'Invalid: repeated matra (ाा / ीी / etc.)'
    WHEN len(list_filter(range(1, length(word) - 1), lambda i: substr(word, i::INT, 1) = substr(word, i::INT + 1, 1) AND substr(word, i::INT, 1) = substr(word, i::INT + 2, 1))) > 0 THEN 'Invalid: triple character repetition'
    WHEN contains('{spelling.SIGNS}{spelling.NASALS}', substr(word, 1, 1)) THEN 'Invalid: starts with vowel sign / nasal'
    WHEN ends_with(word, '्') THEN 'Suspicious: ends with halant'
    WHEN regexp_matches(word, '[{spelling.VOWELS}][{spelling.SIGNS}]') THEN 'Invalid: vowel sign after independent vowel' END AS fault FROM asked),
judged AS (SELECT f.word, CASE WHEN NOT mostly THEN ['SKIP', 'N/A', 'Not Devanagari text']
    WHEN f.word IN (FROM known) THEN ['CORRECT', 'HIGH', 'Found in reference dictionary']
    WHEN fault IS NOT NULL THEN ['INCORRECT', 'HIGH', fault]
    WHEN {_PLAIN('f.word')} <> f.word AND {_PLAIN('f.word')} IN (FROM known) THEN ['CORRECT', 'HIGH', 'Nukta/nasal variant of ''' || {_PLAIN('f.word')} || '''']
    WHEN r.reason IS NOT NULL THEN ['CORRECT', 'MEDIUM', r.reason]
    WHEN length(f.word) <= 2 AND pure AND contains('{spelling.CONSONANTS}{spelling.VOWELS}', substr(f.word, 1, 1)) THEN ['CORRECT', 'MEDIUM', 'Short valid Devanagari word (likely particle/suffix)']
    WHEN pure AND length(f.word) BETWEEN 2 AND 15 THEN ['CORRECT', 'MEDIUM', 'Valid Devanagari structure (2-15 chars, no violations)']
    WHEN pure AND length(f.word) > 15 THEN ['INCORRECT', 'LOW', 'Unusually long word (>15 chars) — possible concatenation error']
    ELSE ['INCORRECT', 'LOW', 'Not in dictionary, ambiguous structure — needs manual review'] END AS v FROM faults f LEFT JOIN roots r ON f.word = r.word),
verdicts AS (SELECT word, v[1] AS classification, v[2] AS confidence, v[3] AS reason FROM judged)"""
)
_UNIT = "string_split('" + " ".join(w.split("/")[0] for w in lexicon.NUMBERS.split()) + "', ' ')"
_FAR = "और फिर बहुत देर के बाद हम सब घर लौटे"
_SPELLED = f"CASE WHEN event_id % 900 + 1 >= 100 THEN {_UNIT}[(event_id % 900 + 1) // 100 + 1] || ' सौ' || CASE WHEN (event_id % 900 + 1) % 100 > 0 THEN ' ' ELSE '' END ELSE '' END || CASE WHEN (event_id % 900 + 1) % 100 > 0 THEN {_UNIT}[(event_id % 900 + 1) % 100 + 1] ELSE '' END"
_TAGGED = "split_part('नई [EN]वेबसाइट[/EN] कल खुलेगी|टीवी पर [EN]वीडियो[/EN] देखना ठीक नहीं|यह [EN]लैपटॉप[/EN] और वह [EN]सर्वर[/EN], दोनों [EN]broken[/EN] हैं|check-in कब होगा', '|', (event_id % 4 + 1)::INT)"
_SEGMENTS = "parts AS (SELECT *, unnest(range(0, event_id % 3 + 1)) AS i FROM events), segs AS (SELECT event_id, i::INT AS i, CASE WHEN (event_id + i) % 13 = 0 THEN '  ' ELSE ' ' || event_type || ' ' END AS text, round(round(value, 2) + i, 2) AS s, round(round(value, 2) + i + (event_id + 7 * i) % 40, 2) AS e FROM parts)"
_CATALOG = "cat AS (SELECT o_orderkey AS recording_id, CASE WHEN o_orderkey % 5 = 0 THEN 'https://example.org/other/' ELSE 'https://example.org/recordings/hi/' || o_custkey || '/' END AS root, o_totalprice AS duration_s FROM orders)"

ORACLE = {
    "wer_per_sample": f"WITH {_PAIRS} SELECT id, k, words, errors, round(wer_percent, 6) AS wer_percent FROM errors",
    "wer_corpus": f"WITH {_PAIRS} SELECT k, sum(errors)::BIGINT AS errors, sum(words)::BIGINT AS words, round(sum(errors) * 100.0::DOUBLE / sum(words), 6) AS wer FROM errors GROUP BY k",
    "wer_macro": f"WITH {_PAIRS} SELECT k, round(avg(wer_percent), 6) AS mean_wer, round(min(wer_percent), 6) AS min_wer, round(max(wer_percent), 6) AS max_wer FROM errors GROUP BY k",
    "wer_improvement": f"WITH {_PAIRS}, rates AS (SELECT k, sum(errors) * 100.0::DOUBLE / sum(words) AS wer FROM errors GROUP BY k) SELECT r.k, round(b.wer - r.wer, 6) AS absolute, round((b.wer - r.wer) / nullif(b.wer, 0) * 100, 6) AS relative FROM rates r, rates b WHERE b.k = 0 AND r.k > 0",
    "severity_buckets": f"WITH {_PREDICTIONS} SELECT {_SEVERITY} AS severity, count(*) AS n FROM predictions GROUP BY 1",
    "systematic_sample": f"WITH {_SAMPLED} SELECT id, severity, round(wer_percent, 6) AS wer_percent FROM sampled",
    "sample_ids": f"WITH {_SAMPLED} SELECT row_number() OVER (ORDER BY place, wer_percent, id)::INT AS sample_id, id FROM sampled",
    "error_taxonomy": f"WITH {_TAXONOMY} SELECT id, array_to_string(labels, ' | ') AS error_categories FROM labelled",
    "taxonomy_histogram": f"WITH {_TAXONOMY} SELECT category, count(*) AS occurrences, round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM labelled), 6) AS percent FROM each GROUP BY 1",
    "top3_fixes": f"WITH {_TAXONOMY}, tops AS (SELECT category, count(*) AS occurrences, min((id, place)) AS f FROM each GROUP BY 1), fixes AS (SELECT * FROM (VALUES {', '.join(str((c, f, FIX_DETAILS[c])) for c, f in taxonomy.FIXES.items())}) t(category, proposed_fix, implementation_detail)) SELECT row_number() OVER (ORDER BY occurrences DESC, f)::INT AS rank, category, occurrences, proposed_fix, implementation_detail FROM tops JOIN fixes USING (category) ORDER BY 1 LIMIT 3",
    "category_examples": f"WITH {_TAXONOMY}, numbered AS (SELECT category, row_number() OVER (PARTITION BY category ORDER BY id)::INT AS n, id FROM each) SELECT * FROM numbered WHERE n <= 5",
    "word_diff": f"WITH {_HINDI}, t AS (SELECT id, string_split(ref, ' ') AS r, string_split(hyp, ' ') AS h FROM hindi) SELECT id, array_to_string(list_sort(list_distinct(list_filter(h, lambda w: NOT list_contains(r, w)))), ' ') AS added, array_to_string(list_sort(list_distinct(list_filter(r, lambda w: NOT list_contains(h, w)))), ' ') AS deleted FROM t",
    "number_roundtrip": "SELECT l_orderkey, l_linenumber, floor(l_extendedprice)::BIGINT::VARCHAR AS digits FROM lineitem",
    "number_normalize": "SELECT l_orderkey, l_linenumber, 'उसने ' || floor(l_extendedprice)::BIGINT || ' रुपये दिये' AS converted FROM lineitem",
    "idiom_guard": f"SELECT event_id, CASE event_id % 3 WHEN 0 THEN {_UNIT}[event_id % 99 + 2] || ' पहला' WHEN 1 THEN 'दोनों भाई {_FAR} {_FAR} ' || (event_id % 99 + 1) ELSE 'दो-चार बातें ' || (event_id % 99 + 1) END AS converted FROM events",
    "tag_loanwords": f"SELECT event_id, {_TAGGED} || ' ' || CASE WHEN regexp_matches(event_type, '^[a-zA-Z]{{2,}}$') THEN '[EN]' || event_type || '[/EN]' ELSE event_type END AS tagged FROM events",
    "post_process": f"SELECT event_id, (event_id % 900 + 1) || ' [EN]स्टूडेंट[/EN] ने ' || {_TAGGED} AS processed FROM events",
    "align_positions": f"WITH RECURSIVE {_ALIGNED} SELECT id, k, pos, word FROM aligned",
    "lattice_bins": f"WITH RECURSIVE {_ALIGNED}, positions AS (SELECT DISTINCT id, pos, ref[pos + 1] AS own FROM aligned) SELECT p.id, p.pos, array_to_string(list_sort(list_append(coalesce(list(a.word) FILTER (a.word IS NOT NULL), []), p.own)), ' ') AS valid, coalesce(min_by(a.word, a.first_model), p.own) AS primary FROM positions p LEFT JOIN agreed a ON a.id = p.id AND a.pos = p.pos GROUP BY p.id, p.pos, p.own",
    "lattice_wer_by_model": f"""WITH RECURSIVE {_ALIGNED}, spared AS (SELECT a.id, a.k, count(*) AS n FROM aligned a JOIN agreed g ON a.id = g.id AND a.pos = g.pos AND a.word = g.word GROUP BY ALL),
        sums AS (SELECT e.k, sum(words)::BIGINT AS words, sum(errors)::BIGINT AS errors, sum(errors - coalesce(n, 0))::BIGINT AS lattice_errors FROM errors e LEFT JOIN spared s ON e.id = s.id AND e.k = s.k GROUP BY e.k)
        SELECT 'Model ' || k AS model, words, errors, lattice_errors, round(errors * 100.0::DOUBLE / words, 2) AS standard_wer, round(lattice_errors * 100.0::DOUBLE / words, 2) AS lattice_wer,
               round(errors * 100.0::DOUBLE / words - lattice_errors * 100.0::DOUBLE / words, 2) AS delta, CASE WHEN errors * 100.0::DOUBLE / words - lattice_errors * 100.0::DOUBLE / words > 0.5 THEN 'Yes' ELSE 'No' END AS fairly_penalized FROM sums""",
    "spell_classify": f"WITH {_VERDICTS} SELECT * FROM verdicts",
    "spell_counts": f"WITH {_VERDICTS} SELECT classification, count(*) AS n, round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM verdicts), 6) AS percent FROM verdicts GROUP BY 1",
    "spell_crosstab": f"WITH {_VERDICTS} SELECT classification, count(*) FILTER (confidence = 'HIGH') AS high, count(*) FILTER (confidence = 'MEDIUM') AS medium, count(*) FILTER (confidence = 'LOW') AS low, count(*) FILTER (confidence = 'N/A') AS none FROM verdicts GROUP BY 1",
    "spell_top_reasons": f"WITH {_VERDICTS} SELECT reason, count(*) AS n FROM verdicts GROUP BY 1 ORDER BY n DESC, reason LIMIT 10",
    "spell_review_sample": f"WITH {_VERDICTS} SELECT word, reason FROM verdicts WHERE confidence = 'LOW' ORDER BY md5(word), word LIMIT 50",
    "spell_high_incorrect": f"WITH {_VERDICTS} SELECT word, reason FROM verdicts WHERE classification = 'INCORRECT' AND confidence = 'HIGH'",
    "dictionary_union": f"WITH {_DICTIONARY} SELECT word FROM known",
    "json_segments": f"WITH {_SEGMENTS} SELECT event_id AS recording_id, i AS pos, text, s AS start FROM segs",
    "segment_gate": f"WITH {_SEGMENTS} SELECT event_id || '_seg000' || i || '.wav' AS audio, trim(text) AS sentence, round(e - s, 2) AS duration_s FROM segs WHERE trim(text) <> '' AND e - s BETWEEN 1.0 AND 30.0",
    "segment_stats": f"WITH {_CATALOG} SELECT count(*) AS n, round(sum(duration_s), 4) AS total_s, round(sum(duration_s) / 3600, 4) AS hours, round(avg(duration_s), 4) AS mean_s, round(median(duration_s), 4) AS median_s, round(min(duration_s), 4) AS min_s, round(max(duration_s), 4) AS max_s FROM cat",
    "url_fallback": f"WITH {_CATALOG} SELECT recording_id, CASE WHEN contains(root, 'recordings') THEN '{BACKUP}' || replace(root, 'https://example.org/recordings/hi/', '') || recording_id || '_audio.wav' END AS url FROM cat",
    "sibling_urls": f"WITH {_CATALOG} SELECT recording_id, root || recording_id || '.wav ' || root || recording_id || '.mp3 ' || root || recording_id || '_metadata.json' AS urls FROM cat",
    "download_tasks": f"WITH {_CATALOG}, kinds AS (SELECT * FROM (VALUES ('audio', '_audio.wav'), ('transcription', '_transcription.json')) t(label, tail)) SELECT recording_id, root || recording_id || tail AS url, recording_id || tail AS dest, label FROM cat, kinds",
    "peak_normalize": "WITH e AS (SELECT vec_id, embedding AS x, list_max(list_transform(embedding, lambda v: abs(v::DOUBLE))) AS top FROM embeddings) SELECT vec_id, unnest(range(0, len(x)))::INT AS pos, round(unnest(list_transform(x, lambda v: CASE WHEN top > 0 THEN v::DOUBLE / top * 0.95::DOUBLE ELSE v::DOUBLE END)), 6) AS sample FROM e",
    "sample_slice": "WITH e AS (SELECT vec_id, embedding[3:8] AS x FROM embeddings) SELECT vec_id, unnest(range(0, len(x)))::INT AS pos, round(unnest(x)::DOUBLE, 6) AS sample FROM e",
    "train_eval_split": "SELECT o_orderkey, CASE WHEN ('0x' || substr(md5(o_orderkey::VARCHAR), 1, 6))::BIGINT % 100 < 90 THEN 'train' ELSE 'test' END AS split FROM orders",
    "script_filters": f"WITH {_WORDS} SELECT id, {_MOSTLY} AS mostly, {_PURE} AS pure FROM words",
    "display_columns": "WITH c AS (SELECT c_custkey, c_mktsegment, c_name || ' ' || c_mktsegment || ' segment text' AS t FROM customer) SELECT c_custkey, CASE WHEN length(t) > 35 THEN substr(t, 1, 33) || '…' ELSE t END AS short, 'model_' || replace(lower(c_mktsegment), ' ', '_') AS slug, repeat('█', (c_custkey % 101) // 2) AS bar FROM customer JOIN c USING (c_custkey, c_mktsegment)",
    "sql_functions": f"SELECT event_id, (event_id % 900 + 1) || ' [EN]स्टूडेंट[/EN] ने ' || {_TAGGED} AS processed, len(string_split({_SPELLED}, ' '))::INT AS errors FROM events",
    "call_scalar": "SELECT '350 [EN]स्टूडेंट[/EN] आए' AS processed",
    "download_outcomes": f"WITH {_CATALOG} SELECT recording_id % 3 AS part, count(*) FILTER (contains(root, 'recordings')) AS succeeded, count(*) FILTER (NOT contains(root, 'recordings')) AS failed FROM cat GROUP BY 1",
    "recordings_with_files": "SELECT o_orderkey AS recording_id FROM orders WHERE o_orderkey % 7 <> 0 AND o_orderkey % 11 <> 0",
    "slice_gate": "WITH s AS (SELECT vec_id, greatest(0, least(len(embedding), trunc((vec_id % 9) / 2 * 8)::INT) - 2) AS n FROM embeddings) SELECT vec_id, n::INT AS samples, n > 0 AND n / 8 BETWEEN 0.5 AND 3.0 AS usable FROM s",
    "json_schema": "SELECT event_id AS recording_id, event_id % 6 <> 0 AS is_list FROM events",
    "wrapped": """WITH RECURSIVE w AS (SELECT item_id, list_filter(string_split_regex(coalesce(text, ''), '\\s+'), lambda x: x <> '') AS l FROM benchmark),
        walk AS (SELECT item_id, l, 1 AS p, 0 AS line, length(l[1]) AS used FROM w WHERE len(l) > 0
                 UNION ALL SELECT item_id, l, p + 1, CASE WHEN used + 1 + length(l[p + 1]) <= 75 THEN line ELSE line + 1 END, CASE WHEN used + 1 + length(l[p + 1]) <= 75 THEN used + 1 + length(l[p + 1]) ELSE length(l[p + 1]) END FROM walk WHERE p < len(l))
        SELECT item_id, line, (count(*) - 1)::INT AS spaces, max(used) <= 75 AS fits FROM walk GROUP BY item_id, line""",
    "training_metric": "WITH t AS (SELECT l_partkey % 49 + 1 AS label, l_partkey % 49 + CASE WHEN l_suppkey % 5 = 0 THEN 2 ELSE 1 END AS g, l_orderkey, l_linenumber FROM lineitem), "
    "u AS (SELECT *, CASE WHEN g > 49 THEN 1 ELSE g END AS guess FROM t), o AS (SELECT l_orderkey, list(label ORDER BY l_linenumber) AS ref, list(guess ORDER BY l_linenumber) AS hyp FROM u GROUP BY 1), "
    "costs AS (SELECT *, list_transform(ref, lambda r: [list_transform(hyp, lambda h: (h <> r)::INT)]) AS cost FROM o), "
    "d AS (SELECT len(ref) AS words, list_reduce(cost, lambda acc, x: list_append(acc, list_reduce(list_transform(range(1, len(hyp) + 1), lambda j: [j::INT]), lambda cur, jj: list_append(cur, least(cur[jj[1]] + 1, acc[-1][jj[1] + 1] + 1, acc[-1][jj[1]] + x[1][jj[1]])), [acc[-1][1] + 1])), [list_transform(range(0, len(hyp) + 1), lambda j: j::INT)])[-1][-1] AS errors FROM costs) "
    "SELECT round(sum(errors) * 100.0::DOUBLE / sum(words), 6) AS wer FROM d",
}
