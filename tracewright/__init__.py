"""Application-log analytics on Spark: from raw lines to incident timelines and probable root causes."""
