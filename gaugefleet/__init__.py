"""gaugefleet: fleet-scale GPU performance analytics on Spark DataFrames."""
