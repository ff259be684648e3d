"""op9: every page through WARC archives and back."""

from __future__ import annotations

from tickloom.llm.common import read
from tickloom.llm.warc import normalise, read_records, with_revisits, write_archives
from tickloom.session import shared_dir, stage


def op9_warc_normalise(spark, sf_dir):
    folder = shared_dir(spark)
    archives = stage(write_archives(with_revisits(read(spark, sf_dir, "pages")), f"{folder}/raw"))
    index = stage(normalise(archives, f"{folder}/records"))
    return read_records(index, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


CHECK = """
with p as (select page_id, coalesce(html, '') as html, strlen(coalesce(html, '')) as n from pages),
c as (select html, max(page_id) as best from p where n >= 1000 group by html having count(*) > 1 and max(page_id) is not null)
select page_id, cast(n as bigint) as payload_bytes, sha1(html) as payload_digest,
  case when best is not null and (page_id is null or page_id <> best) then 'revisit' else 'response' end as record_type,
  case when best is not null and (page_id is null or page_id <> best) then best end as refers_to
from p left join c using (html)"""
