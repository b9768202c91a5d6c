"""Table schemas, enumerations and bit masks of the crawl data model.

One physical table per entity, partitioned by ``site_id``; names are snake case.
"""

from __future__ import annotations

from pyspark.sql import types as T

_KIND = {"s": T.StringType(), "i": T.IntegerType(), "l": T.LongType(), "d": T.DoubleType(), "t": T.TimestampNTZType(), "b": T.BinaryType(), "a": T.ArrayType(T.StringType())}


def table(spec: str) -> T.StructType:
    """A schema from ``name:kind`` words; kinds: s string, i int, l long, d double, t timestamp_ntz, b binary, a array of strings."""
    return T.StructType([T.StructField(n, _KIND[k]) for n, k in (w.split(":") for w in spec.split())])


SITES = table("id:s user_id:l u_date:t tc_date:t c_date:t resources:l contents:l collected_urls:l new_urls:l deleted_urls:l iterations:l state:i priority:i max_urls:l max_resources:l max_errors:l max_resource_size:l request_delay:l processing_delay:l http_timeout:l error_mask:l errors:l url_type:i fetch_type:i size:l avg_speed:d avg_speed_counter:l recrawl_period:l recrawl_date:t max_urls_from_page:l")
SITE_FILTERS = table("site_id:s pattern:s subject:s op_code:i stage:i action:i type:i mode:i state:i group_id:i")
SITE_PROPERTIES = table("site_id:s name:s value:s url_md5:s")
PROXIES = table("site_id:s host:s domains:a priority:i state:i limits:s faults:i faults_max:i freq:l category_id:i country:s description:s")
URLS = table("site_id:s url:s url_md5:s type:i state:i status:i crawled:l processed:l content_type:s request_delay:l processing_delay:l http_timeout:l charset:s batch_id:l error_mask:l crawling_time:l processing_time:l total_time:l http_code:i c_date:t u_date:t tc_date:t p_date:t http_method:s size:l links_i:l links_e:l freq:l depth:i raw_content_md5:s parent_md5:s last_modified:t e_tag:s m_rate:d m_rate_counter:l max_urls_from_page:l tags_mask:l tags_count:i content_url_md5:s priority:i")
URL_LOG = table("site_id:s url_md5:s op_code:i object:s o_date:t")
ATTRIBUTES = table("site_id:s url_md5:s name:s value:s c_date:t")
CONTENTS = table("site_id:s id:s data:s c_date:t")
RAW_CONTENTS = table("site_id:s url_md5:s kind:s ctime:t body:b")
PAGE_PROPS = table("site_id:s url_md5:s title:s redirects:a internal_links:a external_links:a")
TASKS = table("id:l state:i priority:i r_time:t r_time_max:t tries:i delay:l host:s port:i started:t finished:t u_date:t")
NODE_RESOURCES = table("node_id:s cpu:l io:l ram_free:l disk_free:l threads:l processes:l cpu_cores:i state:i u_date:t")

# Enumerations (fixed values of the data model).
SITE_STATE = {"active": 1, "disabled": 2, "suspended": 3}
URL_STATE = {"enabled": 0, "disabled": 1, "error": 2}
URL_STATUS = {"undefined": 0, "new": 1, "selected_crawling": 2, "crawling": 3, "crawled": 4, "selected_processing": 5, "processing": 6, "processed": 7, "selected_crawling_incremental": 8}
FILTER_OP = {"re": 0, "eq": 1, "noteq": 2, "eqless": 3, "eqmore": 4, "less": 5, "more": 6, "sqle": 7}
ACTION = {"exclude": -1, "include": 1}
ROUTING = {"multicast": 0, "round_robin": 1, "random": 2, "resource_usage": 3}

#: Tables by name, for sources and sinks.
ALL = {"sites": SITES, "site_filters": SITE_FILTERS, "site_properties": SITE_PROPERTIES, "proxies": PROXIES, "urls": URLS, "urls_deleted": URLS, "url_log": URL_LOG, "attributes": ATTRIBUTES, "contents": CONTENTS, "raw_contents": RAW_CONTENTS, "page_props": PAGE_PROPS, "tasks": TASKS, "node_resources": NODE_RESOURCES}
