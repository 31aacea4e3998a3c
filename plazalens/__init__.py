"""plazalens: labelling, claim checking and reporting over social posts, on Spark."""
