"""fathomline.streaming"""
