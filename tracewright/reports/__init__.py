"""Reports of an analysis.  Only the timelines asked for come to the driver."""
