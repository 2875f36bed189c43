"""Input and output of sequencing reads."""
