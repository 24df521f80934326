"""Named queries over the tables of a data folder, each beside its SQL where there is one."""
