WITH p AS (SELECT floor(page_id / 64)::BIGINT AS n, page_id, url, coalesce(html, '') AS html FROM pages WHERE page_id IS NOT NULL AND url <> ''),
b AS (SELECT *, 'HTTP/1.1 200 OK' || chr(13) || chr(10) || 'Content-Type: text/html; charset=utf-8' || chr(13) || chr(10) || 'Content-Length: ' || octet_length(encode(html)) || chr(13) || chr(10) || chr(13) || chr(10) || html AS block,
      regexp_replace(url, '\s', '%20', 'g') AS uri, 'leafmill-' || lpad(n::VARCHAR, 8, '0') || '.arc' AS archive FROM p),
r AS (SELECT archive, row_number() OVER (PARTITION BY archive ORDER BY page_id, url, html) AS place, 'response' AS warc_type, uri, strftime(TIMESTAMP '2009-01-01' + to_seconds(page_id), '%Y-%m-%dT%H:%M:%SZ') AS date, '192.0.2.' || (page_id % 250 + 1) AS ip, 'application/http; msgtype=response' AS content_type, block, html AS payload FROM b
      UNION ALL SELECT DISTINCT archive, 0, 'warcinfo', 'filedesc://' || archive, '2009-01-01T00:00:00Z', NULL, 'application/warc-fields', i, i
      FROM (SELECT archive, 'software: leafmill' || chr(13) || chr(10) || 'format: WARC File Format 1.0' || chr(13) || chr(10) || 'isPartOf: ' || archive || chr(13) || chr(10) AS i FROM b)),
h AS (SELECT *, sha1(block) AS hb, sha1(payload) AS hp FROM r),
d AS (SELECT *, 'sha1:' || array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(hb, (5 * i // 4 + 1)::BIGINT, 2))::INTEGER >> (3 - 5 * i % 4)::INTEGER) & 31) + 1)::BIGINT, 1)), '') AS block_digest,
      'sha1:' || array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(hp, (5 * i // 4 + 1)::BIGINT, 2))::INTEGER >> (3 - 5 * i % 4)::INTEGER) & 31) + 1)::BIGINT, 1)), '') AS payload_digest FROM h),
m AS (SELECT *, md5(archive || chr(10) || place || chr(10) || warc_type || chr(10) || uri || chr(10) || date || chr(10) || block_digest) AS id FROM d)
SELECT archive, warc_type, '<urn:uuid:' || id[1:8] || '-' || id[9:12] || '-' || id[13:16] || '-' || id[17:20] || '-' || id[21:32] || '>' AS record_id, uri AS target_uri, date AS warc_date, ip AS ip_address, content_type,
       octet_length(encode(block)) AS content_length, block_digest, payload_digest, false AS truncated FROM m
