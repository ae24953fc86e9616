"""Posting-inventory views derived from the star schema; the text runs in Spark and in other SQL engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
AS_OF = "timestamp '2001-08-01 00:00:00'"

VIEWS = {
    "fx_postings": """select concat(case when l_returnflag='A' then 'greenhouse:' when l_returnflag='R' then 'schema:' else 'registry:' end, cast(l_suppkey as string)) source,
     concat(cast(l_orderkey as string),'-',cast(l_linenumber as string),'-',cast(l_partkey as string)) source_id,
     case when l_returnflag='A' then 'direct' when l_returnflag='R' and l_linestatus='F' then 'verification' when l_returnflag='R' then 'verification-lead' when l_linestatus='F' then 'registry' else 'external-index' end source_mode,
     s_name company,
     concat(p_name,' ',case p_type when 'STANDARD' then 'Software Engineering Intern - Summer 2027' when 'SMALL' then 'Data Analyst Intern (Fall 2027)' when 'LARGE' then 'Machine Learning Intern' when 'ECONOMY' then 'Quantitative Trading Intern - Summer 2026' when 'MEDIUM' then 'Senior Accountant' else 'Hardware Co-op 2027' end) title,
     n_name loc1, case when o_orderpriority='5-LOW' then 'Remote' else r_name end loc2,
     concat('HTTPS://Jobs.Example.com/jobs/',cast(l_partkey as string),'-',cast(l_suppkey as string),'/?utm_source=',o_orderstatus,'&b=1') apply_url,
     case when l_linenumber % 3 = 0 then null else l_shipdate end posted_at,
     o_orderdate first_seen_at, greatest(o_orderdate,l_shipdate) last_seen_at, o_orderstatus<>'F' active
    from lineitem join orders on l_orderkey=o_orderkey join part on l_partkey=p_partkey join supplier on l_suppkey=s_suppkey join nation on s_nationkey=n_nationkey join region on n_regionkey=r_regionkey""",
    "fx_targets": """select concat('greenhouse:',cast(s_suppkey as string)) source,
     case s_nationkey % 4 when 0 then 'greenhouse' when 1 then 'lever' when 2 then 'workday-search' else 'domain' end kind,
     case when s_suppkey % 11 = 0 then 'historical' else 'current' end scope, s_suppkey % 13 <> 0 validated, true enabled, true scheduled,
     900*(1+s_suppkey % 4) interval_seconds,
     case when s_suppkey % 17 = 0 then null else m end last_complete_at, m last_finished_at,
     case s_suppkey % 6 when 0 then 'broken' when 1 then 'partial' when 2 then 'empty' else 'ok' end last_status, s_suppkey % 5 consecutive_failures
    from supplier join (select l_suppkey k, max(o_orderdate) m from lineitem join orders on l_orderkey=o_orderkey group by l_suppkey) z on k=s_suppkey""",
    "fx_snapshots": """select concat('greenhouse:',cast(l_suppkey as string)) source, cast(date_trunc('month',o_orderdate) as timestamp) finished_at,
     (l_suppkey + extract(month from o_orderdate)) % 5 <> 0 complete, count(*) rows_scanned, sum(case when p_type in ('STANDARD','PROMO') then 1 else 0 end) target_rows,
     sum(case when l_linenumber=1 then 1 else 0 end) new_rows, sum(case when l_returnflag='R' then 1 else 0 end) removed_rows
    from lineitem join orders on l_orderkey=o_orderkey join part on l_partkey=p_partkey group by 1,2,3""",
    "fx_candidates": """select concat('domain:',cast(p_partkey as string)) source, lower(p_type) kind, case when p_size % 3=0 then 'historical' else 'current' end scope, p_size evidence_count,
     case p_partkey % 4 when 0 then 'candidate' when 1 then 'retry' when 2 then 'validated' else 'rejected' end status, p_partkey % 7 consecutive_failures from part""",
    "fx_observations": """select concat('sensor:',event_type) source, cast(user_id as string) source_id, ts observed_at, case when event_type in ('purchase','signup') then 'direct' else 'market-sensor' end source_mode, value from events""",
    "fx_urls": """select page_id, url from pages""",
    "fx_links": """select p_partkey id, p_name label, p_size n, lower(p_type) kind, case p_partkey % 16
      when 0 then concat('https://boards.greenhouse.io/acme', cast(p_size as string), '/jobs/', cast(p_partkey as string), '?gh_src=x')
      when 1 then concat('https://jobs.lever.co/Acme/01234567-89AB-cdef-0123-', lpad(cast(p_partkey as string), 12, '0'), '/apply')
      when 2 then concat('https://jobs.ashbyhq.com/Acme/01234567-89ab-cdef-0123-', lpad(cast(p_size as string), 12, '0'))
      when 3 then concat('https://www.google.com/about/careers/applications/jobs/results/', cast(p_partkey as string), '-role?utm_source=a')
      when 4 then concat('https://jobs.smartrecruiters.com/Acme/7439', lpad(cast(p_partkey as string), 8, '0'))
      when 5 then concat('https://www.amazon.jobs/en/jobs/', cast(p_partkey as string), '/sde?ref=a&x=1')
      when 6 then concat('https://acme.wd5.myworkdayjobs.com/en-US/Careers/job/NYC/Role_R-', cast(p_partkey as string))
      when 7 then concat('https://careers.acme.co.uk/jobs/?gh_jid=', cast(p_size as string), '&utm_campaign=z&b=2#top')
      when 8 then 'https://github.com/acme/jobs'
      when 9 then concat('https://acme', cast(p_size as string), '.recruitee.com/o/role-', cast(p_partkey as string))
      when 10 then concat('https://apply.workable.com/acme', cast(p_size as string), '/j/ABC', cast(p_partkey as string))
      when 11 then concat('https://acme.fa.oraclecloud.com/hcmUI/CandidateExperience/en/sites/CX_1/job/', cast(p_partkey as string))
      when 12 then concat('https://careers-acme.icims.com/jobs/', cast(p_partkey as string), '/login')
      when 13 then 'HTTP://www.Acme.com//careers//open/?source=x&Ref=y&k=v'
      when 14 then concat('https://ats.rippling.com/en-US/acme', cast(p_size as string), '/jobs/', cast(p_partkey as string))
      else concat('not a url ', cast(p_partkey as string)) end url from part""",
    "fx_texts": """select p_partkey id, p_name name, p_size n, case p_partkey % 8
      when 0 then concat('<b>', p_name, '</b> &amp; Co, Inc.') when 1 then concat('[', p_name, '](https://x.example/a) LLC') when 2 then 'BAE Systems, Inc.' when 3 then concat(p_name, ' (US) GmbH')
      when 4 then 'Google LLC' when 5 then concat('  ', p_name, ' - ') when 6 then '' else concat(p_name, '<br/>Corp') end company,
     concat(p_name, case p_partkey % 6 when 0 then ' Intern II' when 1 then ' Engineering Internship (Summer 2027)' when 2 then ' Engineer - Remote' when 3 then ' Intern - Fall 2027' when 4 then ' Data Analyst or Trader' else ' Co-op | Austin, TX' end) title,
     case p_partkey % 7 when 0 then 'HTTP 403 Forbidden' when 1 then 'Read timed out' when 2 then 'json decode failed' when 3 then 'candidate' when 4 then null when 5 then 'Certificate expired' else 'odd thing' end reason,
     case p_partkey % 6 when 0 then concat(cast(p_size as string), ' days ago') when 1 then 'yesterday' when 2 then concat(cast(p_size + 1000000000 as string), '') when 3 then '2001-07-04' when 4 then concat(cast(p_size as string), 'h') else 'soon' end age,
     case p_partkey % 4 when 0 then 'Posted Today' when 1 then concat('Posted ', cast(p_size as string), '+ Days Ago') when 2 then '2001-07-04T10:00:00Z' else 'Posted' end workday from part""",
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view, or a table, of the given folder."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = VIEWS[name]
    used = [t for t in TABLES if f" {t} " in f"{text} ".replace("\n", " ").replace(")", " ) ")]
    for t in used:
        for word in ("from", "join"):
            text = text.replace(f"{word} {t} ", f"{word} {{{t}}} ")
        text = text[: -len(t)] + f"{{{t}}}" if text.endswith(f"from {t}") else text
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used}
    if name == "fx_postings":
        # The largest table is one file with one row group. Its rows are dealt out here, where they are narrow, by the key
        # of the join that comes first, which would shuffle them so anyway.
        tables["lineitem"] = tables["lineitem"].repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "l_orderkey")
    return spark.sql(text, **tables)
