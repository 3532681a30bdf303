"""framewright: media frames, packets and samples as Spark DataFrames."""
