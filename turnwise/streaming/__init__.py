"""Row-wise operators over file streams."""
