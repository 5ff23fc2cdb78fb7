"""Where tables come from and go to: the shared folder, feeds and exports."""
