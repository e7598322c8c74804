"""Study plans: the data mart of the driver tables, the study facade and its command line."""
