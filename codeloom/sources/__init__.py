"""Sources: repositories, git, ignore rules."""
