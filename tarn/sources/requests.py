"""Requests in JSON: the fields of every request type, and their decoding in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Types of the fields of requests; what is not listed is a string.
FIELD_TYPES = {
    **dict.fromkeys("state status type urlType fetchType priority resources iterations maxURLs maxResources maxErrors maxResourceSize requestDelay processingDelay httpTimeout errorMask errors contents size avgSpeedCounter userId recrawlPeriod maxURLsFromPage collectedURLs crawled processed batchId crawlingTime processingTime totalTime httpCode linksI linksE freq depth tagsMask tagsCount mRateCounter siteSelect algorithm urlUpdate contentTypeMask updateType delayedType rid includeFieldsNames recalcType crawlerType faults faultsMax id".split(), "bigint"),
    **dict.fromkeys("avgSpeed mRate".split(), "double"),
    **dict.fromkeys("urls sitesList dbFieldsList domains".split(), "array<string>"),
    **dict.fromkeys("criterions sitesCriterions urlsCriterions urlCriterions logCriterions properties limits".split(), "map<string,string>"),
    "filters": "array<struct<siteId:string,pattern:string,subject:string,operationCode:int,stage:int,action:int>>",
    "items": "array<struct<siteId:string,urlId:string,properties:map<string,string>>>",
}
_SITE = "siteId uDate tcDate cDate resources iterations description urls filters properties state priority maxURLs maxResources maxErrors maxResourceSize requestDelay httpTimeout errorMask errors urlType contents processingDelay size avgSpeed avgSpeedCounter userId recrawlPeriod recrawlDate maxURLsFromPage collectedURLs fetchType"
_URL = "siteId url urlMd5 type state status siteSelect crawled processed contentType requestDelay processingDelay httpTimeout charset batchId errorMask crawlingTime processingTime totalTime httpCode cDate uDate tcDate pDate httpMethod size linksI linksE freq depth rawContentMd5 parentMd5 lastModified eTag mRate mRateCounter maxURLsFromPage tagsMask tagsCount contentURLMd5 priority"
_PROXY = "siteId host domains priority state limits faults faultsMax freq description"
_ATTRIBUTE = "siteId urlMd5 name value"
#: Fields of the request types.
REQUESTS = {k: v.split() for k, v in {
    "site_new": _SITE, "site_update": _SITE + " updateType criterions", "site_status": "siteId", "site_delete": "siteId delayedType", "site_cleanup": "siteId state status", "site_find": "url criterions",
    "url_new": _URL, "url_status": "siteId url urlType", "url_update": _URL + " criterions", "url_fetch": "algorithm maxURLs sitesList sitesCriterions urlsCriterions urlUpdate", "url_delete": "siteId url urlType criterions delayedType", "url_cleanup": "siteId url urlType state status criterions",
    "url_content": "siteId url urlMd5 contentTypeMask dbFieldsList", "url_purge": "siteId url urlType criterions", "url_verify": "siteId url urlType", "url_age": "sitesCriterions urlsCriterions maxURLs delayedType", "url_put": "siteId urlMd5 contentType criterions properties", "url_history": "siteId urlMd5 urlCriterions logCriterions", "url_stats": "siteId urlMd5 urlCriterions logCriterions",
    "sql_custom": "rid query dbName includeFieldsNames", "batch": "id crawlerType items", "field_recalculate": "siteId recalcType criterions",
    "proxy_new": _PROXY, "proxy_update": _PROXY, "proxy_delete": "siteId host", "proxy_status": "siteId host", "proxy_find": "siteId criterions",
    "attr_set": _ATTRIBUTE, "attr_update": _ATTRIBUTE, "attr_delete": _ATTRIBUTE, "attr_fetch": "siteId urlMd5 name",
}.items()}
FIELDS = sorted({f for fields in REQUESTS.values() for f in fields})


def decoded(rows: DataFrame, kind: str, text: str) -> DataFrame:
    """One row a request: the other columns, ``pos`` in its list, ``error``, and the struct ``request`` with the fields that its type has.

    A text is one request or a list of them. Fields that a type lacks are null, as are missing ones and those of another type of value;
    ``error`` tells an unknown type or a text that is no JSON (then there is one row with a null request).
    """
    known = F.col(kind).isin(*REQUESTS)
    schema = "struct<" + ",".join(f"`{f}`:{FIELD_TYPES.get(f, 'string')}" for f in FIELDS) + ">"
    # URL requests spell two names that site requests have with a small letter; column names do not tell case apart
    c = F.regexp_replace(F.regexp_replace(F.trim(text), r'"CDate"\s*:', '"cDate":'), r'"UDate"\s*:', '"uDate":')
    sound = F.try_parse_json(c).isNotNull()
    each = F.when(c.startswith("["), F.from_json(c, f"array<{schema}>")).otherwise(F.array(F.from_json(c, schema)))
    error = F.when(~F.coalesce(known, F.lit(False)), "unknown request").when(~F.coalesce(sound, F.lit(False)), "no JSON")
    out = rows.withColumn("error", error).select("*", F.posexplode_outer(F.when(F.col("error").isNull(), each)).alias("pos", "_r"))
    has = {f: F.col(kind).isin(*[k for k, fields in REQUESTS.items() if f in fields]) for f in FIELDS}
    fields: list[Column] = [F.when(has[f], F.col("_r")[f]).alias(f) for f in FIELDS]
    return out.withColumn("request", F.when(F.col("_r").isNotNull(), F.struct(*fields))).withColumn("pos", F.coalesce("pos", F.lit(0))).drop("_r", text)
