"""Air-traffic, aviation-weather and map-tile analytics on Spark DataFrames."""
