"""Where tables and contracts come from."""
