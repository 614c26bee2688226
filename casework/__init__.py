"""casework: coding public events and quoted posts from large web-page tables."""
