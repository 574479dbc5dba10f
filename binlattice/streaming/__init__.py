"""Contact maps kept up to date from streams of pairs."""
