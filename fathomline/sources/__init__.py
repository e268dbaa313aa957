"""fathomline.sources"""
