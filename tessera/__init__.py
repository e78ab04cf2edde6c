"""Site-fleet analytics on Spark: signals, links, scores, gates and snapshot diffs as DataFrame plans."""
