"""Queries registered with the driver, grouped like the operators they call."""


def modules():
    from beaconry.catalog import alert_queries, ingest_queries, log_queries, metric_queries, pattern_queries, report_queries, source_queries, stream_queries, trace_queries

    return [log_queries, metric_queries, trace_queries, alert_queries, ingest_queries, report_queries, pattern_queries, source_queries, stream_queries]
