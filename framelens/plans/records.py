"""Input records derived from the given tables, in SQL that Spark and DuckDB share.

These shape inputs only (whole tables, no row is left out); the operators
under test never appear here.
"""

RECORDS: dict[str, str] = {
    # Web links in several spellings: www, upper case, no scheme, institutional and compound hosts.
    "links": """
        SELECT page_id, html,
          CASE page_id % 12
            WHEN 0 THEN replace(url, '://', '://www.')
            WHEN 1 THEN upper(url)
            WHEN 2 THEN replace(replace(url, 'https://', ''), 'http://', '')
            WHEN 3 THEN replace(url, '.example.', '.gov.')
            WHEN 4 THEN replace(url, '.example.com', '.example.co.uk')
            WHEN 5 THEN replace(url, '.example.', '.edu.')
            WHEN 6 THEN replace(replace(url, '.example.net', '.blogspot.de'), '.example.com', '.arxiv.org')
            WHEN 7 THEN replace(replace(url, '.example.org', '.mil.fr'), '/en/', '/russia/')
            WHEN 8 THEN replace(replace(url, '.example.com', '.livejournal.com'), '.example.org', '.tass.ru')
            WHEN 9 THEN replace(url, '/en/', '/annexed-coast/')
            WHEN 10 THEN ''
            ELSE url END AS url
        FROM {pages}""",
    # Directory of hosts: every other parent domain has an entry.
    "directory": """
        SELECT n_name AS name, lower(concat(CASE WHEN n_nationkey % 2 = 0 THEN 'example' ELSE 'blogspot' END, '.',
          CASE n_nationkey % 5 WHEN 0 THEN 'org' WHEN 1 THEN 'net' WHEN 2 THEN 'com' WHEN 3 THEN 'de' ELSE 'fr' END)) AS domain,
          CASE n_regionkey WHEN 0 THEN 'news' WHEN 1 THEN 'society' WHEN 2 THEN 'tech' WHEN 3 THEN 'games' ELSE 'health' END AS type,
          n_nationkey AS line_no
        FROM {nation}""",
    # Forced-choice answers.
    "answers": """
        SELECT l.l_orderkey * 1000000 + l.l_partkey * 10 + l.l_linenumber AS row_id,
          concat('m', CAST(l.l_suppkey % 12 AS string)) AS model,
          concat('q', CAST(l.l_linenumber AS string)) AS question_id,
          CASE WHEN l.l_linenumber = 6 THEN 'geography' ELSE 'yesno' END AS question_type,
          CASE WHEN l.l_orderkey % 5 = 0 THEN '' ELSE concat('c', CAST(l.l_orderkey % 5 AS string)) END AS city,
          CASE l.l_partkey % 5 WHEN 0 THEN 'en' WHEN 1 THEN 'fr' WHEN 2 THEN 'de' WHEN 3 THEN 'es' ELSE 'xx' END AS language,
          CASE WHEN l.l_linenumber = 6 THEN 'north' WHEN l.l_linenumber % 2 = 0 THEN 'yes' ELSE 'no' END AS expected,
          CASE CAST(l.l_quantity AS int) % 9
            WHEN 0 THEN 'Yes, it is.' WHEN 1 THEN '  Oui, bien sur' WHEN 2 THEN 'Nein.' WHEN 3 THEN 'No'
            WHEN 4 THEN 'That is complicated' WHEN 5 THEN 'In the Northland' WHEN 6 THEN 'The Southland' WHEN 7 THEN 'Ja!'
            ELSE 'I would rather not say' END AS raw_answer,
          CASE WHEN l.l_quantity = 50 THEN NULL ELSE l.l_discount < 0.05 END AS correct,
          CASE CAST(l.l_quantity AS int) % 6 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' WHEN 2 THEN 'disputed' WHEN 3 THEN 'other'
            WHEN 4 THEN 'yes' ELSE 'no' END AS classified,
          CASE l.l_linenumber % 4 WHEN 0 THEN 'D' WHEN 1 THEN 'L' WHEN 2 THEN 'I' ELSE 'R' END AS tier
        FROM {lineitem} l""",
    # Open-ended answers.
    "open_answers": """
        SELECT conv_id, turn, text AS raw_answer,
          CASE WHEN role = 'user' THEN 'qa' ELSE 'qb' END AS question_id
        FROM {conversations}""",
    # Articles with a title, a finding query and a date.
    "articles": """
        SELECT doc_id, lang, source,
          concat(CASE doc_id % 7 WHEN 0 THEN 'Occupied coast: ' WHEN 1 THEN 'Northern coast ' WHEN 2 THEN 'Southern coast ' ELSE '' END,
            substr(text, 1, 60)) AS title,
          concat('https://', source, CASE doc_id % 4 WHEN 0 THEN '.example.de/north/coast/' WHEN 1 THEN '.example.fr/south/coast/'
            WHEN 2 THEN '.example.co.uk/annex/' ELSE '.example.org/a/' END, CAST(doc_id % 400 AS string)) AS url,
          CASE WHEN doc_id % 5 = 0 THEN '' ELSE CASE lang WHEN 'en' THEN 'English' WHEN 'de' THEN 'German' ELSE '' END END AS language,
          CASE WHEN doc_id % 6 = 0 THEN 'Narnia' ELSE '' END AS sourcecountry,
          CASE doc_id % 3 WHEN 0 THEN 'pro_a' WHEN 1 THEN 'pro_b' ELSE 'critical' END AS query_label,
          CASE WHEN doc_id % 9 = 0 THEN '' ELSE concat(CAST(2010 + doc_id % 15 AS string), '0301') END AS date,
          concat(CAST(2010 + doc_id % 15 AS string), 'Q1') AS period,
          text
        FROM {documents}""",
    # Papers with DOI variants and journals.
    "papers": """
        SELECT p_partkey AS paper_id, p_name AS title, concat('  Journal of ', p_type, ' ') AS journal,
          CASE p_partkey % 6
            WHEN 0 THEN ''
            WHEN 1 THEN concat('https://doi.org/10.1016/j.', CAST(p_partkey % 700 AS string))
            WHEN 2 THEN concat('http://doi.org/10.1093/x.', CAST(p_partkey % 700 AS string))
            WHEN 3 THEN concat('10.', CAST(1000 + p_size AS string), '/z.', CAST(p_partkey % 700 AS string))
            WHEN 4 THEN concat('doi:10.1/', CAST(p_partkey AS string))
            ELSE concat('https://doi.org/10.3390/m', CAST(p_partkey AS string)) END AS doi,
          concat('See 10.', CAST(1000 + p_size * 100 AS string), '/ab.', CAST(p_partkey AS string),
            CASE WHEN p_partkey % 2 = 0 THEN '., and [1-5] (Smith, 2019)' ELSE ' Vol. 3, pp. 12 et al. x' END) AS text,
          CASE WHEN p_partkey % 4 = 0 THEN p_brand ELSE '' END AS publisher,
          CAST(1990 + p_size AS int) AS year, p_brand AS brand, p_size AS size, p_type AS kind, p_retailprice AS price
        FROM {part}""",
    # Journal tiers; one journal is listed under another title and so has none.
    "journal_tiers": """
        SELECT concat('Journal of ', p_type, CASE WHEN p_type = 'SMALL' THEN ' (former title)' ELSE '' END) AS journal,
          CASE WHEN min(p_partkey) % 3 = 0 THEN 'Q1' WHEN min(p_partkey) % 3 = 1 THEN 'Q2' ELSE 'Q3' END AS quartile
        FROM {part} GROUP BY p_type""",
    # Dated citizenship claims per person.
    "claims": """
        SELECT o.o_custkey AS person,
          CASE o.o_orderkey % 5 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'S' WHEN 3 THEN 'A' ELSE NULL END AS country,
          CASE WHEN o.o_orderkey % 3 = 0 THEN CAST(o.o_orderdate AS date) END AS c_start,
          CASE WHEN o.o_orderkey % 4 = 0 THEN CAST(o.o_orderdate AS date) END AS c_end,
          CASE WHEN o.o_custkey % 4 = 0 THEN NULL WHEN o.o_custkey % 4 = 1 THEN DATE '1980-01-01'
            WHEN o.o_custkey % 4 = 2 THEN DATE '1996-01-01' ELSE DATE '2004-01-01' END AS death,
          CASE o.o_orderstatus WHEN 'O' THEN 'normal' WHEN 'F' THEN 'deprecated' ELSE 'preferred' END AS c_rank,
          o.o_orderkey AS claim_id
        FROM {orders} o""",
    # Audit findings.
    "findings": """
        SELECT event_id, concat('p', CAST(user_id AS string)) AS platform, event_type AS category,
          CASE CAST(floor(value) AS int) % 5 WHEN 0 THEN 'correct' WHEN 1 THEN 'incorrect' WHEN 2 THEN 'ambiguous' WHEN 3 THEN 'blocked' ELSE 'n/a' END AS status,
          CASE WHEN event_id % 2 = 0 THEN 'manual' ELSE 'automated_api' END AS method,
          CASE event_id % 4 WHEN 0 THEN 'UA' WHEN 1 THEN 'RU' WHEN 2 THEN 'RU,UA' ELSE 'UA,RU' END AS codes,
          CASE event_id % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE NULL END AS code,
          value, ts
        FROM {events}""",
    # Registry key-value records.
    "registry_kv": """
        SELECT o_custkey AS asn, o_orderkey AS line_no,
          CASE o_orderkey % 5 WHEN 0 THEN 'created' WHEN 1 THEN 'org' WHEN 2 THEN 'status' WHEN 3 THEN 'remarks' ELSE 'other' END AS k,
          CASE o_orderkey % 5 WHEN 0 THEN CAST(CAST(o_orderdate AS date) AS string) WHEN 3 THEN concat('mail Abuse@net.', lower(substr(o_orderpriority, 3, 2)))
            ELSE o_orderpriority END AS value
        FROM {orders}""",
    # Verdict texts of a reviewer.
    "verdicts": """
        SELECT l_orderkey, l_linenumber, l_partkey,
          CASE CAST(l_quantity AS int) % 5 WHEN 0 THEN 'ENDORSES the claim' WHEN 1 THEN 'It reports it' WHEN 2 THEN 'Hard to say, endorses' WHEN 3 THEN 'Analyzes.' ELSE '' END AS response,
          CASE CAST(l_quantity AS int) % 6 WHEN 0 THEN 'endorses' WHEN 1 THEN 'reports' WHEN 2 THEN 'unclear' WHEN 3 THEN 'fetch_failed' WHEN 4 THEN 'error' ELSE 'endorses' END AS verdict,
          l_returnflag AS quartile, l_linestatus AS journal, l_discount > 0.05 AS sacred, l_tax > 0.04 AS legal
        FROM {lineitem}""",
    # Citations of answers.
    "responses": """
        SELECT c.conv_id * 100 + c.turn AS response_id, c.role AS model,
          CASE WHEN c.conv_id % 3 = 0 THEN 'en' WHEN c.conv_id % 3 = 1 THEN 'de' ELSE 'fr' END AS language,
          concat(c.text, ' see https://a', CAST(c.conv_id % 7 AS string), '.example.org/x and (https://www.state', CAST(c.turn % 3 AS string), '.example.ru/y) again https://a',
            CAST(c.conv_id % 7 AS string), '.example.org/x or https://m.gov.example/z') AS text,
          c.text AS plain, c.conv_id, c.turn
        FROM {conversations} c""",
}
