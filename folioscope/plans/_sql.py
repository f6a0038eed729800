"""The SQL prefix that builds the star, shared by all oracles."""

STAR = r"""
WITH pap AS (
  SELECT paper_id, venue_id, is_conference = 'True' AS is_conference, CAST(CASE WHEN year BETWEEN 1950 AND 2029 THEN year END AS INTEGER) AS year,
         CASE WHEN trim(title) NOT IN ('', 'None') THEN title END AS title, CASE WHEN trim(ref_id) NOT IN ('', 'None') THEN ref_id END AS ref_id,
         CASE WHEN trim(cites) NOT IN ('', 'None') THEN cites END AS cites, CASE WHEN trim(abstract) NOT IN ('', 'None') THEN abstract END AS abstract, doi_url, cited_count
  FROM (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY loaded_at DESC, cited_count DESC NULLS LAST) rn FROM papers) WHERE rn = 1
), per AS (
  SELECT person_id, name, gender FROM (SELECT *, row_number() OVER (PARTITION BY person_id ORDER BY loaded_at DESC, name) rn FROM persons) WHERE rn = 1
), ven AS (SELECT venue_id, acronym, name, impact, is_conference = 1 AS is_conference FROM venues
), aut AS (SELECT paper_id, person_id, CAST(min(pos) AS INTEGER) AS pos FROM authorship WHERE person_id IS NOT NULL GROUP BY 1, 2
), slots AS (SELECT a.*, p.year, p.venue_id, p.is_conference, p.cited_count FROM aut a JOIN pap p USING (paper_id)
), owner AS (SELECT ref_id, max(paper_id) AS dst FROM pap WHERE ref_id IS NOT NULL GROUP BY 1
), refs AS (SELECT paper_id AS src, unnest(regexp_extract_all(cites, '[^\s,;|/"''\[\]{}()]+')) AS ref_id FROM pap WHERE cites IS NOT NULL
), cit AS (SELECT src, dst FROM refs JOIN owner USING (ref_id)
), wrd AS (SELECT paper_id, unnest(regexp_extract_all(lower(coalesce(abstract, title)), '[\p{L}\p{N}_]{3,}')) AS w FROM pap
), dt AS (SELECT paper_id, CAST(length(w) % 11 AS INTEGER) AS topic, count(*) AS cnt FROM wrd GROUP BY 1, 2
), seats AS (SELECT DISTINCT person_id, venue_id, year FROM pc_membership
), pcp AS (SELECT DISTINCT s.paper_id FROM slots s JOIN seats USING (person_id, venue_id, year)
), pairs AS (SELECT x.person_id AS a, y.person_id AS b, count(*) AS cnt FROM aut x JOIN aut y ON x.paper_id = y.paper_id AND x.person_id < y.person_id GROUP BY 1, 2
)"""
