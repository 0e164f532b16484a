"""Table readers, versioned state and scratch tables."""
